import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from strandloom.llm import prefix_trie as t

SCHEMA = "conv_id long, turn int, role string, text string, depth int"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:30]


def slow(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, digest(role, text), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for v in members:
        if v:
            children[v[:-1]].append(v)

    out = set()
    sums = {}
    for v in sorted(members, key=len, reverse=True):
        below = [sums[u] for u in children[v]]
        saved = (len(members[v]) - 1) * (len(v[-1][1].encode()) if v else 0)
        sums[v] = (sum(x[0] for x in below) + saved, sum(x[1] for x in below) or 1)
    for v, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(v))
        out.add((min(cs), len(v), min(members[v[:-1]]) if v else None, len(cs), len(children[v]), sums[v][1], sums[v][0], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def some(rng, convs, longest):
    rows = []
    for c in convs:
        for i in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([i, i, None]), rng.choice(["user", "bot", None]), rng.choice(["hi", "hé", "", None, "x" * 50]), 7))
    return rows


def run(spark, rows, parts=3):
    got = t.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    return [tuple(r)[:8] for r in got], got


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = some(rng, [rng.randint(-60, 60) for _ in range(90)], 4) + [(200, i, "user", f"t{i}", 0) for i in range(30)] + [(201, i, "user", f"t{i}", 0) for i in range(30)]
    rows += [(202, i, "user", f"t{i}", 0) for i in range(30)] + [(None, 1, "user", "x", 0), (7_000_000_000, 1, "user", "only", 0)]
    got, _ = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == slow(rows)


def test_one_conversation_in_many_parts(spark, monkeypatch):
    """A conversation of a third of all rows lies in several ranges, and its prefixes in several buckets."""
    monkeypatch.setattr(t, "BUCKET", 16)
    rng = random.Random(9)
    rows = some(rng, range(40), 5) + [(5, i, "user", str(i % 7), 0) for i in range(400)] + [(6, i, "user", str(i % 7), 0) for i in range(390)]
    got, full = run(spark, rows)
    assert set(got) == slow(rows)
    texts = defaultdict(list)
    for c, turn, role, text, _ in rows:
        texts[c].append((turn is not None, turn or 0, digest(role or "", text or ""), text or ""))
    assert all(0 < r["ref_turn"] <= len(texts[r["ref_conv_id"]]) for r in full if r["depth"])


def test_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(t, "IDS", 8)
    rows = [(5 * c, i, "user", f"t{i}", 0) for c in range(300) for i in range(3)]
    got, _ = run(spark, rows)
    assert set(got) == slow(rows)


def test_no_rows_and_only_turnless(spark):
    assert t.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    rows = [(c, 0, "user", "gone", 0)]
    got, _ = run(spark, rows)
    assert set(got) == slow(rows) == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


def test_collisions_are_found(spark):
    turns = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (3, 4, "c")], "c1 long, c2 long, framed string")
    assert not t.digests_hold(turns) and t.digests_hold(turns.filter("framed != 'b'"))
