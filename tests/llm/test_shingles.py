import random

import numpy as np
import pyarrow as pa

from strandloom.llm import shingles
from strandloom.llm.shingles import alike_groups, bands_of, shingle_sets
from strandloom.llm.simhash import simhash_stage


def rows():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(900)]
    out = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "two one")]
    for k in range(25):
        base = rng.choices(vocabulary, k=rng.choice([30, 120, 400]))
        for j in range(6):
            ws = list(base)
            for at in rng.sample(range(len(ws)), j * len(ws) // 120):
                ws[at] = rng.choice(vocabulary)
            out.append((100 + 10 * k + j, " ".join(ws)))
    out.append((90, out[-1][1]))
    return out


def slow(texts):
    sets = {}
    for key, text in texts:
        ws = (text or "").lower().split()
        sets[key] = {" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
    linked = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    name = {k: k for k in sets}
    while True:
        new = {k: min(name[o] for o in sets if linked(sets[k], sets[o])) for k in sets}
        if new == name:
            return name
        name = new


def test_equals_brute_force(spark):
    texts = rows()
    want = slow(texts)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for piece in (2048, 3):
        assert {r["doc_id"]: r["component_id"] for r in alike_groups(df, piece).collect()} == want
    left = sorted(r["doc_id"] for r in simhash_stage(spark, df, "").collect())
    assert left == sorted(set(want.values())) and len(left) < len(texts) - 40


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alike_groups(none).collect() == [] and simhash_stage(spark, none, "").collect() == []
    df = spark.createDataFrame([(None, "a b"), (5, "a b"), (None, "c d"), (5, "e f"), (5, "e f")], "doc_id long, text string")
    assert sorted((r[0] or 0, r[2] or 0) for r in alike_groups(df).collect()) == [(0, 0), (0, 5), (5, 5), (5, 5), (5, 5)]


def test_stage_with_shared_ids(spark):
    rows = [(3, "text of one", "x"), (3, "another text here", "y"), (4, "a third one", "z"), (4, "a third one", "a"), (9, "another text here", "q"), (None, "a third one", None), (7, None, "e"), (8, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash_stage(spark, df, "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[1], rows[3], rows[5], rows[6]], key=str)


def test_bands_find_pairs_at_the_limit():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 110, dtype=np.uint64)
        one, other = x[:99], np.concatenate([x[:88], x[99:]])
        assert (bands_of(one) == bands_of(other)).any()
    assert [len(s) for s in shingle_sets(__import__("pyarrow").array(["a b c d e f", "a", None]))] == [2, 1, 0]


def test_fingerprints_join_by_pigeonring(spark):
    """Links come from near fingerprints only, of whole texts or of samples, and only between texts that are alike."""
    words = [f"w{i}" for i in range(300)]
    texts = [(k, " ".join(words[:299] + [f"end{k}"])) for k in range(8)] + [(8, "quite another text of seven words"), (9, "and one more")]
    df = shingles.with_keys(spark.createDataFrame(texts, "doc_id long, text string"))
    batch = pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "text": r["text"], "th": r["th"]} for r in df.orderBy("doc_id").collect()])
    marks = pa.Table.from_batches(shingles.marks_of(iter([batch]))).to_pylist()
    assert all(len(m["prints"]) == 1 + shingles.BANDS for m in marks)
    rng = np.random.default_rng(6)
    far = rng.integers(0, 1 << 62, (10, 1 + shingles.BANDS))
    far[1, 0] = far[0, 0] ^ 0b1111  # four bits of a whole text: a link
    far[3, 0] = far[2, 0] ^ 0b11111 ^ 1 << 50  # six bits: none
    far[5, 7] = far[4, 7] ^ 1 << 40  # one bit of a sample: a link
    far[7, 9] = far[6, 9] ^ 3 << 40  # two bits: none
    far[9, 0] = far[8, 0]  # the same fingerprint, but other texts: none
    nodes = [(m["doc_id"], m["a"], m["b"], m["doc_id"], m["th"], [int(x) for x in far[k]]) for k, m in enumerate(marks)]
    nodes = spark.createDataFrame(nodes, "node long, a long, b long, doc_id long, th long, prints array<long>")
    assert sorted(tuple(sorted(r)) for r in shingles.alike_links(df, nodes).distinct().collect()) == [(0, 1), (4, 5)]


def test_drifting_copies_in_pieces(spark):
    """No head is alike to all of its bucket: links go on from copy to copy, beside a second family and outliers."""
    rng = random.Random(8)
    base, texts = [f"w{i}" for i in range(400)], []
    for k in range(40):
        base[10 * k % 400 + rng.randint(0, 9)] = f"new{k}"
        texts.append((k, " ".join(base)))
    for k in range(12):
        ws = [f"w{i}" for i in range(300)] + [f"other{k % 2}-{i}" for i in range(90)]
        ws[7 * k + 3] = f"x{k}"
        texts.append((100 + k, " ".join(ws)))
    want = slow(texts)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for piece in (2048, 4):
        assert {r["doc_id"]: r["component_id"] for r in alike_groups(df, piece).collect()} == want


def test_rows_grow_as_a_group_of_near_copies(spark, monkeypatch):
    """Twice the near copies make about twice the rows that are compared, in buckets far over a piece."""

    def counted(f, rows):
        def g(batches):
            for batch in batches:
                rows.add(batch.num_rows)
                yield batch

        return lambda batches: f(g(batches))

    def compared(n):
        rows = spark.sparkContext.accumulator(0)
        with monkeypatch.context() as m:
            for name in ("head_links", "bucket_links", "group_links"):
                m.setattr(shingles, name, counted(getattr(shingles, name, None), rows), raising=False)
            words = [f"w{i}" for i in range(400)]
            texts = [(k, " ".join([*words[: 3 * k], f"new{k}", *words[3 * k + 1 :]])) for k in range(n)]
            found = alike_groups(spark.createDataFrame(texts, "doc_id long, text string"), 4).collect()
        assert {r["component_id"] for r in found} == {0} and len(found) == n
        return rows.value

    assert compared(96) <= 3 * compared(48)
