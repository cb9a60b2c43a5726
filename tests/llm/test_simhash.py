import re

import xxhash

from strandloom.llm import simhash
from strandloom.llm.simhash import near_duplicates

SCHEMA = "doc_id long, text string, extra string, component_id long"


def slow(rows):
    prints = {}
    for key, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        ws = re.findall(r"[^\x20\x09-\x0D]+", low)
        sh = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
        prints[key] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    name = {k: k for k in prints}
    while True:
        new = {k: min(name[o] for o in prints if (prints[k] ^ prints[o]).bit_count() <= 4) for k in prints}
        if new == name:
            return {k: (f"{prints[k]:016x}", name[k]) for k in prints}
        name = new


def some(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r[0] + 10, r[1]) for r in docs]
    long = " ".join(r[1] for r in rows[:20])
    words = long.split(" ")
    for i in range(40):  # near copies of a long text
        changed = list(words)
        changed[i * 7 % len(words)] = f"new{i}"
        rows.append((1000 + i, " ".join(changed)))
    return rows + [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b c"), (7, " "), (2000, long), (2001, long)]


def test_equals_brute_force(spark):
    rows = some(spark)
    want = slow(rows)
    df = spark.createDataFrame([(a, b, "x", 7) for a, b in rows], SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(df).collect()}
    assert got == want
    # The same in small pieces: buckets of over 3 rows are compared piece by piece.
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(df, piece=3).collect()} == want


def test_chain_keys_miss_no_pair():
    import random

    rng = random.Random(1)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(diff & mask == 0 and len(simhash.within_budgets(simhash.np.array([diff], dtype="uint64"), start)) for start, mask in simhash.chain_keys())


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(none).collect() == []
    rows = [(3, "a b", "", 0), (3, "a b", "", 0), (None, "a b", "", 0), (None, "other words", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (3, 3)]
    kept = simhash.simhash_stage(spark, df, "").collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == [(-1, "a b"), (-1, "other words"), (3, "a b")]
