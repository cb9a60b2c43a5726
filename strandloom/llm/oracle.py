"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: Weights 5, 2, 1 by source; targets by water filling; copies of a queue one after the other, ordered by finish time.
FAIR_QUEUEING = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('10:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key, row_number() OVER () AS row
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
c AS (SELECT *, (3 * source_size)::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM c WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE cap > level * weight),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM f) * weight, cap)) AS target FROM l),
q AS (
  SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (
  SELECT row, key, size, r * source_size + upto AS sent, (r * source_size + upto)::DOUBLE / target AS finish
  FROM q, range(3) AS u(r) WHERE size > 0 AND target > 0 AND r * source_size + upto - size < target),
y AS (SELECT row, size, sum(size) OVER (ORDER BY finish, key, row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM x),
k AS (SELECT row, sum(size) AS taken FROM y WHERE total <= (SELECT sum(size) FROM d) GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN k USING (row)
"""

#: All strings of 200 bytes, counted; starts of those met again are merged to spans, and what lies between is kept.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, row_number() OVER () AS row, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT row, i, md5_number(substr(h, (2 * i + 1)::INT, 400)) AS s FROM d, unnest(range(greatest(length(h) // 2 - 199, 0))) AS u(i)),
r AS (SELECT row, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
g AS (SELECT row, i, sum(new) OVER (PARTITION BY row ORDER BY i) AS span FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY row ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM r)),
m AS (SELECT row, span, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY row, span),
p AS (SELECT row, span, a, b, coalesce(lag(b) OVER (PARTITION BY row ORDER BY span), 0) AS before, max(b) OVER (PARTITION BY row) AS last FROM m),
k AS (SELECT p.row, sum(b - a)::BIGINT AS removed, count(*) AS spans, string_agg(substr(h, (2 * before + 1)::INT, (2 * (a - before))::INT), '' ORDER BY span) || any_value(substr(h, (2 * last + 1)::INT)) AS kept FROM p JOIN d USING (row) GROUP BY p.row)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (row)
"""

#: The table of the reflected CRC-32 polynomial, and the CRC of the bytes of a hexadecimal string.
CRC_TABLE = """SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) AS r(i))"""


def crc(hexed: str) -> str:
    """SQL for the unsigned CRC-32 of a column of hexadecimal digits, beside a row of ``CRC_TABLE``."""
    octets = f"list_transform(regexp_extract_all({hexed}, '..'), lambda x: ('0x' || x)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::INT])), 4294967295::UBIGINT)::BIGINT"


#: Rebuilt conversations as lists of turns, all their prefixes grouped, and each node's prefixes for sums over subtrees.
PREFIX_TRIE = f"""
WITH crcs AS ({CRC_TABLE}),
own AS (
  SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hs AS (SELECT c, turns, {crc("hex(encode(c::VARCHAR))")} % 9 AS h FROM own, crcs),
whole AS (SELECT a.c, list_concat(coalesce(b.turns, [])[1:h], a.turns[h + 1:]) AS turns FROM hs AS a LEFT JOIN own AS b ON b.c = a.c - a.c % 5),
member AS (SELECT c, turns[1:d] AS path, d = len(turns) AS last FROM whole, unnest(range(len(turns) + 1)) AS u(d)),
node AS (
  SELECT path, len(path) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(strlen(path[len(path)].text), 0) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
  FROM member GROUP BY path),
child AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT n.path[1:d] AS path, sum(n.saved) AS saved, count(*) FILTER (c.path IS NULL) AS leaves
  FROM node AS n LEFT JOIN child AS c ON c.path = n.path, unnest(range(n.depth + 1)) AS u(d) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM node AS n JOIN below AS b ON b.path = n.path LEFT JOIN child AS c ON c.path = n.path LEFT JOIN node AS p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""



def best_fit(k: str) -> str:
    """SQL for a struct whose ``put`` has a bin (from 1) for each of ``ss``, the falling sizes; it is null if ``bins`` of the
    capacity at step ``k`` don't do."""
    start = "{'s': 0::BIGINT, 'free': []::BIGINT[], 'put': []::BIGINT[]}"
    cap = f"(fair + (fair * {k} + 4095) // 4096)"
    fit = "list_min(list_filter(a.free, lambda y: y >= x.s))"
    at = f"list_position(a.free, {fit})"
    taken = f"list_concat(a.free[1:{at} - 1], [{fit} - x.s], a.free[{at} + 1:])"
    return f"""list_reduce(list_prepend({start}, list_transform(ss, lambda z: {{'s': z, 'free': []::BIGINT[], 'put': []::BIGINT[]}})), lambda a, x: CASE
      WHEN a.put IS NULL THEN a
      WHEN {fit} IS NOT NULL THEN {{'s': 0::BIGINT, 'free': {taken}, 'put': list_append(a.put, {at}::BIGINT)}}
      WHEN len(a.free) < bins AND x.s <= {cap} THEN {{'s': 0::BIGINT, 'free': list_append(a.free, {cap} - x.s), 'put': list_append(a.put, len(a.free) + 1)}}
      ELSE {{'s': 0::BIGINT, 'free': []::BIGINT[], 'put': NULL::BIGINT[]}} END).put"""


#: Best fit one group at a time, for capacities at the steps 0, 1, 2, 4 and so on, and then halving the last interval.
BEST_FIT_SHARDS = f"""
WITH RECURSIVE crcs AS ({CRC_TABLE}),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS g, hex(encode(coalesce(text, ''))) AS h FROM documents),
o AS (SELECT g, s, row_number() OVER (ORDER BY s DESC, g) AS i FROM (SELECT g, sum(size)::BIGINT AS s FROM d GROUP BY g)),
items AS (SELECT list(s ORDER BY i) AS s, count(*) AS n, sum(s)::BIGINT AS total FROM o),
giant(lone, rest) AS (
  SELECT 0::BIGINT, total FROM items
  UNION ALL SELECT lone + 1, rest - s[lone + 1] FROM giant, items WHERE lone < least(15, n) AND s[lone + 1] * (16 - lone) >= rest),
g AS (SELECT max(lone) AS lone, 16 - max(lone) AS bins, (min(rest) + 15 - max(lone)) // (16 - max(lone)) AS fair FROM giant),
j AS (SELECT lone, bins, fair, s[lone + 1:] AS ss FROM g, items),
coarse AS (SELECT k, {best_fit("k")} IS NOT NULL AS ok FROM j, (SELECT unnest([0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096]::BIGINT[]) AS k)),
span AS (SELECT high, CASE WHEN high < 2 THEN high - 1 ELSE high // 2 END AS low FROM (SELECT min(k) AS high FROM coarse WHERE ok)),
fine AS (SELECT k, {best_fit("k")} IS NOT NULL AS ok FROM j, (SELECT unnest(range(low + 1, high)) AS k FROM span)),
halved(low, high) AS (
  SELECT low, high FROM span
  UNION ALL SELECT CASE WHEN ok THEN low ELSE k END, CASE WHEN ok THEN k ELSE high END FROM halved JOIN fine ON k = (low + high) // 2 WHERE high - low > 1),
put AS (SELECT lone, {best_fit("k")} AS put FROM j, (SELECT min(high) AS k FROM halved)),
shards AS (SELECT lone + u.i AS i, lone + put[u.i] - 1 AS shard FROM put, unnest(range(1, len(put) + 1)) AS u(i) UNION ALL SELECT lone, lone - 1 FROM giant WHERE lone > 0)
SELECT doc_id, size, {crc("h")} AS text_crc32, 'bytes' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY d.g, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM d JOIN o ON o.g = d.g JOIN shards USING (i), crcs
"""

#: Near words by strings with one code point left out: of both at the same place, or of the longer one only.
SPELLING_VARIANTS = f"""
WITH RECURSIVE crcs AS ({CRC_TABLE}),
r AS (
  SELECT key, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS key, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY key, run),
b AS (SELECT *, hex(encode(key || ':' || run)) AS hexed FROM r),
h AS (SELECT run, n, {crc("hexed")} AS h FROM b, crcs),
w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM w, unnest(range(length(word))) AS u(i)),
p AS (
  SELECT x.word AS a, y.word AS b FROM x JOIN x AS y USING (i, rest) WHERE x.word != y.word
  UNION SELECT x.word, w.word FROM x JOIN w ON w.word = x.rest
  UNION SELECT w.word, x.word FROM x JOIN w ON w.word = x.rest),
f AS (SELECT a AS word, count(*) AS n_near, min({{'m': -n, 'w': b}}) AS top FROM p JOIN w ON w.word = p.b GROUP BY a),
o AS (SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -top.m >= 2 * n THEN top.w END AS form, CASE WHEN -top.m >= 2 * n THEN -top.m END AS form_n FROM w LEFT JOIN f USING (word)),
t(word, root, step) AS (SELECT word, word, 0 FROM o UNION ALL SELECT t.word, o.form, step + 1 FROM t JOIN o ON o.word = t.root WHERE o.form IS NOT NULL),
l AS (SELECT word, arg_max(root, step) AS root FROM t GROUP BY word)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM o JOIN l USING (word)
"""
