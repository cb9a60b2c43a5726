"""Groups of texts with alike sets of word shingles.

A text has several SimHash fingerprints: one of all of its shingles, and one of each of ``BANDS`` min-wise samples of
``ROWS`` shingles. Candidates have near fingerprints, found by pigeonring filtering: at most four bits differ in those of
whole texts, at most one in those of a sample. Two candidates link if the Jaccard similarity of their shingle sets, which
is computed in full, is ``LEAST`` or more. Whole texts just at 0.8 differ in some ten bits, too many for a join on
segments; samples are there for those: such a pair has no sample in common with a chance of 1 in 16,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import keep, slices, words
from strandloom.llm.components import components
from strandloom.llm.pigeonring import BITS, SEGMENTS, key_structs

#: Words of a shingle; least similarity of a link, as a fraction; samples, and shingles in each.
SHINGLE, LEAST, BANDS, ROWS = 5, (4, 5), 32, 6
#: Segments and bits of a ring: of a whole text's fingerprint, and of a sample's. A key's number is its ring's times KEYS and more.
RINGS, KEYS = ((SEGMENTS, BITS), (2, 1)), 64
#: Most bits in which near fingerprints differ, by ring.
LIMITS = np.array([RINGS[0][1], *[RINGS[1][1]] * BANDS])
#: Rows of one group that are compared in one piece; what is not tied in a larger group is dealt out as pairs of pieces.
PIECE = 2048

_RNG = np.random.default_rng(17)
FLIP = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(col: pa.Array) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's shingles; a shorter text is one shingle, one without words has none."""
    flat, offs = words(col)
    d = flat.dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w) for w in d.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    w = known[np.asarray(d.indices)] if len(flat) else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        size = min(SHINGLE, b - a)
        if not size:
            out.append(np.zeros(0, np.uint64))
            continue
        n = b - a - size + 1
        h = np.full(n, size, np.uint64)
        for j in range(size):
            h += w[a + j : a + j + n] * PLACE[j]
        out.append(np.unique(mixed(h)))
    return out


def set_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of each set."""
    a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    b = np.array([mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return a.view(np.int64), b.view(np.int64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash of the hashes along the last axis but the bits: a bit is 1 if set in over half of them."""
    ones, n = np.zeros((*h.shape[:-1], 64), np.int64), h.shape[-1]
    for at in range(0, n, 4096):
        part = np.ascontiguousarray(h[..., at : at + 4096])
        ones += np.unpackbits(part.view(np.uint8).reshape(*part.shape, 8), axis=-1, bitorder="little").sum(axis=-2, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=-1, bitorder="little").view(np.int64)[..., 0]


def bands_of(s: np.ndarray) -> np.ndarray:
    """Fingerprints of the samples of a set: of the shingles that have the least hash under each of ``ROWS`` functions."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(s), 512):
        least = np.minimum(least, ((s[at : at + 512, None] ^ FLIP) * TIMES).min(axis=0))
    return fingerprint(mixed(least).reshape(BANDS, ROWS))


def prints_of(s: np.ndarray) -> np.ndarray:
    """Fingerprint of a whole set, then those of its samples."""
    return np.append(fingerprint(s), bands_of(s))


def marks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 8 << 20):
        sets = shingle_sets(batch.column("text"))
        a, b = set_ids(sets)
        prints = np.concatenate([prints_of(s) for s in sets])
        offs = pa.array(np.arange(len(sets) + 1) * (BANDS + 1), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(a), pa.array(b), pa.ListArray.from_arrays(offs, pa.array(prints))], ["doc_id", "th", "a", "b", "prints"])


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 8 << 20):
        sets = shingle_sets(batch.column("text"))
        a, b = set_ids(sets)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array([s.tobytes() for s in sets], pa.binary())], ["a", "b", "shingles"])


def alike(one: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the sets, back to back in ``flat``, are LEAST or more similar to ``one``."""
    there = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.bincount(np.repeat(np.arange(len(size)), size), there, minlength=len(size))
    up, down = LEAST
    return both * (up + down) >= up * (len(one) + size)


def near(prints: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which rows of fingerprints are near to ``own`` on some ring: then, and only then, they share one of its buckets."""
    return (np.bitwise_count(prints ^ own) <= LIMITS).any(axis=1)


def prints_and_sets(prints: pa.Array, shingles: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    flat = np.asarray(prints.flatten()).view(np.uint64)
    return flat.reshape(len(prints), -1), [np.frombuffer(x, np.uint64) for x in shingles.to_pylist()]


def head_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links a, b of heads with others, in a partition sorted by head and part, where a head's own row comes first."""
    one = own = None
    for batch in batches:
        if not batch.num_rows:
            continue
        head, part, node = (np.asarray(batch.column(i)) for i in range(3))
        prints, sets = prints_and_sets(batch.column(3), batch.column(4))
        hits = [np.zeros(0, np.int64)]
        cut = (np.flatnonzero((head[1:] != head[:-1]) | (part[1:] != part[:-1])) + 1).tolist()
        for a, b in zip([0, *cut], [*cut, len(head)]):
            if node[a] == head[a]:  # else the rows of the last batch's head go on
                one, own, a = sets[a], prints[a], a + 1
            hit = a + np.flatnonzero(near(prints[a:b], own))
            if len(hit):
                hits.append(hit[alike(one, np.concatenate([sets[i] for i in hit]), np.array([len(sets[i]) for i in hit]))])
        hit = np.concatenate(hits)
        yield pa.RecordBatch.from_arrays([pa.array(head[hit]), pa.array(node[hit])], ["a", "b"])


def walk(sets: list[np.ndarray], prints: np.ndarray, known: np.ndarray) -> tuple[list[int], list[int]]:
    """Index pairs that tie together all sets of a group that links connect, fewer pairs than sets.

    Sets of one ``known`` component are tied already and aren't compared with each other.
    """
    left, right = [], []
    rest = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    up, down = LEAST
    while len(rest):
        tied = known[rest] == known[rest[0]]
        todo, rest = rest[tied].tolist(), rest[~tied]
        while todo and len(rest):
            i = todo.pop()
            some = rest[(sizes[rest] * down >= sizes[i] * up) & (sizes[i] * down >= sizes[rest] * up)]
            some = some[near(prints[some], prints[i])]
            if not len(some):
                continue
            hit = some[alike(sets[i], np.concatenate([sets[j] for j in some]), sizes[some])]
            left += [i] * len(hit)
            right += hit.tolist()
            tied = np.isin(known[rest], known[hit])
            todo += rest[tied].tolist()
            rest = rest[~tied]
    return left, right


def group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links a, b of the groups in a partition that is sorted by group (head, pair)."""
    now, ids, known, prints, sets = None, [], [], [], []

    def links() -> pa.RecordBatch:
        left, right = walk(sets, np.array(prints), np.array(known, np.int64))
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in left], pa.int64()), pa.array([ids[i] for i in right], pa.int64())], ["a", "b"])

    for batch in batches:
        for head, pair, node, component, own, shingles in zip(*[batch.column(i).to_pylist() for i in range(4)], *prints_and_sets(batch.column(4), batch.column(5))):
            if (head, pair) != now:
                if len(ids) > 1:
                    yield links()
                now, ids, known, prints, sets = (head, pair), [], [], [], []
            ids.append(node)
            known.append(component)
            prints.append(own)
            sets.append(shingles)
    if len(ids) > 1:
        yield links()


def by_head(groups: DataFrame, sets: DataFrame, piece: int) -> DataFrame:
    """Links of the heads of ``groups`` (head, node, a, b, n) with all rows of theirs, which are dealt out to parts."""
    part = F.pmod(F.xxhash64("a", "b"), F.ceil(F.col("n") / piece).cast("long"))
    others = groups.filter("node != head").select("head", part.alias("part"), "node")
    rows = others.unionByName(others.select("head", "part", F.col("head").alias("node")).distinct())
    rows = rows.join(sets, "node").select("head", "part", "node", "prints", "shingles").repartition("head", "part")
    return rows.sortWithinPartitions("head", "part", F.col("node") != F.col("head")).mapInArrow(head_links, "a long, b long")


def alike_links(docs: DataFrame, nodes: DataFrame, piece: int = PIECE) -> DataFrame:
    """Links between the nodes (node, a, b, doc_id, th, prints), enough of them to connect all that alike candidates connect.

    Of one ring's buckets with the same members one stays, and so do those of all rings in which all fingerprints are
    the same. A bucket's head is the member whose own buckets hold most rows. Buckets of all rings with the same head
    make one group, in which a text stands once, however many buckets it shares with the head; all near pairs in it are
    compared. In a group of over ``piece`` rows, the head is compared with all others first. What links connect by then,
    in whatever groups, is tied; if not all is, the rows outside of the largest component (the rest) are cut into pieces,
    all rows too, and each two of these are compared in a group of their own: no pair of different components is left
    out, and rows grow as the group while its rest fits in one piece.
    """
    rings = nodes.filter("a != 0 or b != 0").select("node", "a", "b", F.posexplode("prints").alias("ring", "print"))
    keys = F.when(F.col("ring") == 0, key_structs("print", RINGS[0][0])).otherwise(key_structs("print", RINGS[1][0], F.col("ring") * KEYS))
    rows = rings.select("node", "a", "b", "print", F.explode(keys).alias("k")).select("node", "a", "b", "print", "k.key", "k.value")
    # Nearly all buckets hold one row: what is shuffled for these is a key and a number.
    shared = keep(rows.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "value"), "shingle-shared")
    rows = keep(rows.join(shared, ["key", "value"]), "shingle-candidates")
    apart = F.bit_count(F.min("print").bitwiseXOR(F.max("print")))
    full = rows.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.min("a").alias("low"), F.max("a").alias("high"), apart.alias("apart"))
    full = full.withColumn("own", F.when(F.col("apart") > 0, F.floor(F.col("key") / KEYS))).filter((F.col("n") > 2) | (F.col("apart") <= F.when(F.col("own") == 0, RINGS[0][1]).otherwise(RINGS[1][1])))
    full = full.groupBy("n", "x", "low", "high", "own").agg(F.min(F.struct("key", "value")).alias("k")).select("k.key", "k.value", "n")
    members = keep(rows.select("key", "value", "node", "a", "b").join(keep(full, "shingle-buckets"), ["key", "value"]), "shingle-members")
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    heads = members.select("key", "value", "node").join(weights, "node").groupBy("key", "value").agg(F.max(F.struct("weight", (-F.col("node")).alias("least"))).alias("h")).select("key", "value", (-F.col("h.least")).alias("head"))
    groups = keep(members.join(heads, ["key", "value"]).select("head", "node", "a", "b").distinct(), "shingle-heads")
    # One document of each set: its id and text hash find it again. A merge join, as these keys grow with the documents.
    mine = nodes.join(groups.select(F.col("node").alias("n")).distinct(), F.col("node") == F.col("n")).select("node", "a", "b", "doc_id", "th", "prints")
    some = docs.join(mine.select("doc_id", "th").distinct().hint("merge"), ["doc_id", "th"], "left_semi")
    sets = some.mapInArrow(sets_of, "a long, b long, shingles binary").dropDuplicates(["a", "b"])
    sets = keep(mine.join(sets, ["a", "b"]).select("node", "prints", "shingles"), "shingle-sets")
    large = keep(groups.groupBy("head").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > piece), "shingle-large")
    alone = groups.join(F.broadcast(large), "head", "left_anti").select("head", F.lit(0).cast("long").alias("pair"), "node", F.col("node").alias("known"))
    if large.isEmpty():
        return links_in(alone, sets)
    groups = groups.join(F.broadcast(large), "head")
    found = components(by_head(groups, sets, piece).unionByName(links_in(alone, sets)), "shingle-tied").filter("node != component")
    groups = groups.join(found, "node", "left").withColumn("known", F.coalesce("component", "node"))
    tally = groups.groupBy("head", "n", "known").agg(F.count(F.lit(1)).alias("m")).groupBy("head", "n").agg(F.max(F.struct("m", "known")).alias("most"))
    tally = tally.select("head", (F.col("n") - F.col("most.m")).alias("rest"), F.col("most.known").alias("main")).filter("rest > 0")
    groups = groups.join(F.broadcast(tally), "head")
    of = {k: F.ceil(F.col(k) / piece).cast("long") for k in ("n", "rest")}
    own = {k: F.pmod(F.xxhash64("a", "b", F.lit(k)), of[k]) for k in of}
    every = F.transform(F.sequence(F.lit(0).cast("long"), of["rest"] - 1), lambda o: o * of["n"] + own["n"])
    rest = F.transform(F.sequence(F.lit(0).cast("long"), of["n"] - 1), lambda o: own["rest"] * of["n"] + o)
    pair = F.when(F.col("known") == F.col("main"), every).otherwise(F.array_union(every, rest))
    pairs = groups.select("head", F.explode(pair).alias("pair"), "node", "known")
    return found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links_in(pairs, sets))


def links_in(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the groups (head, pair) of nodes (node, known); ``sets`` has their prints and shingles."""
    rows = groups.join(sets, "node").select("head", "pair", "node", "known", "prints", "shingles")
    return rows.repartition("head", "pair").sortWithinPartitions("head", "pair").mapInArrow(group_links, "a long, b long")


def alike_groups(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """doc_id, th (64-bit hash of the text), component_id (the least id reachable over links), group (a number of its
    own for each component) of every row.

    Texts without words have the same, empty set. Texts with the same set are one node. A null id belongs to its
    set's component and never names it (null if there is no other). Rows that share an id are told apart by their
    texts. No rows: no rows.
    """
    docs = with_keys(docs.select("doc_id", "text"))
    marks = keep(docs.mapInArrow(marks_of, "doc_id long, th long, a long, b long, prints array<long>"), "shingle-marks")
    nodes = marks.groupBy("a", "b").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))).alias("least"), F.min("th").alias("any"), F.first("prints").alias("prints"))
    nodes = nodes.select("a", "b", F.col("least.doc_id").alias("doc_id"), F.coalesce("least.th", "any").alias("th"), "prints")
    nodes = keep(nodes.withColumn("node", F.monotonically_increasing_id()), "shingle-nodes")  # numbers are fixed from here on
    # A set that only rows without an id have can be no one's copy and has no links.
    found = components(alike_links(docs, nodes.filter("doc_id is not null"), piece), "shingle-components").withColumnRenamed("node", "n")
    grouped = nodes.select("a", "b", "node", "doc_id").join(found, F.col("node") == F.col("n"), "left").withColumn("group", F.coalesce("component", "node"))
    grouped = keep(grouped.select("a", "b", "group", "doc_id"), "shingle-grouped")
    least = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    named = keep(grouped.drop("doc_id").join(least, "group"), "shingle-named")
    return marks.select("doc_id", "th", "a", "b").join(named, ["a", "b"]).select("doc_id", "th", "component_id", "group")


def with_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with doc_id (long), text (string) and th, the hash of the text (null: of an empty one)."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    return docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))


def one_of_each_group(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """The rows of ``docs`` with the least (id, text hash) of their group, and those without an id. Of rows with the
    same id and text one stays, the first in order of its columns as JSON."""
    groups = keep(alike_groups(docs, piece).filter("doc_id is not null"), "shingle-groups")
    least = groups.groupBy("group").agg(F.min(F.struct("doc_id", "th")).alias("k"), F.count(F.lit(1)).alias("rows")).select(F.col("k.doc_id").alias("_id"), F.col("k.th").alias("_th"))
    least = keep(least, "shingle-least")
    again = groups.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_id", "_th")
    again = keep(again.join(least, ["_id", "_th"]), "shingle-again")
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    mine = (F.col("doc_id").cast("long") == F.col("_id")) & (text_hash == F.col("_th"))
    stay = docs.filter(F.col("doc_id").isNull()).unionByName(docs.join(least.hint("merge"), mine, "left_semi"))
    if again.isEmpty():
        return stay
    once = docs.join(again, mine).groupBy("_id", "_th").agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("_row")).select("_row.*")
    return stay.join(again, mine, "left_anti").unionByName(once)
