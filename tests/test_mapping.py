import random
import re
import time
from itertools import islice

import pytest
from pyspark.sql import functions as F

from strandloom.config import AlignConfig
from strandloom.functions import sequence as s
from strandloom.operators import references as refs_op
from strandloom.operators.find import exact_find, occurrences, suffix_order
from strandloom.operators.kernel import Window, align
from strandloom.operators.paths import paths, streamed_chains, ways
from strandloom.operators.pileup import mutation_lines, ranked
from strandloom.plans import mapping
from strandloom.plans.mapping import Summary, attempts, map_files, map_reads, mutations, place_chains, read_roots, whole_alignment
from strandloom.sources.shared import written
from strandloom.sources.text import mean_read_length, read_reads, read_reference

REF = "GCTAAAGACAATTACATAACATACACGTCAGCACGAAACTTGTTGGCC" + "CAGTGTGAATCGCTTAAGGGTTAAGTAAGTGT"
L, R = REF[8:28], REF[48:68]


def run(spark, tmp_path, reads, order=False):
    (tmp_path / "ref.fa").write_text(">ref\n" + REF[:48] + "\n" + REF[48:] + "\n")
    (tmp_path / "reads.fa").write_text("".join(f">{chr(98 - i) if order else i}\n{r}\n" for i, r in enumerate(reads)))
    return map_files(spark, str(tmp_path / "ref.fa"), str(tmp_path / "reads.fa"), order)


@pytest.mark.parametrize(
    ("left", "lines"),
    [(L, []), ("CAATTACATAACATAGACGT", [">S23 C G"]), ("CAATTACATAACATCACGTC", [">D22 A"]), ("CAATTACATAACATATCACG", [">I22 T"])],
)
def test_end_to_end(spark, tmp_path, left, lines):
    assert [r["line"] for r in run(spark, tmp_path, [left, R]).collect()] == lines


def test_votes_and_odd_record(spark, tmp_path):
    bad = "CAATTACATAACATAGACGT"
    assert run(spark, tmp_path, [L, R, bad, R, "ACGT"]).collect() == []
    assert [r["line"] for r in run(spark, tmp_path, [L, R, bad, R, bad, R]).collect()] == [">S23 C G"]


def test_pairs_and_short_mates(spark, tmp_path):
    run(spark, tmp_path, [R, L])
    ref, rows = read_reference(spark, str(tmp_path / "ref.fa")), read_reads(spark, str(tmp_path / "reads.fa"))
    rows = rows.join(ref.select("ref_id"), F.lit(True))
    assert mean_read_length(rows).first()[0] == 20
    assert [r["mapping"] for r in map_reads(rows, ref).collect()] == [None, None]
    run(spark, tmp_path, [REF[8:23], R])
    rows = read_reads(spark, str(tmp_path / "reads.fa")).join(ref.select("ref_id"), F.lit(True))
    assert [r["mapping"] and r["mapping"]["position"] for r in map_reads(rows, ref).orderBy("read_idx").collect()] == [None, 48]


def test_order(spark, tmp_path):
    got = run(spark, tmp_path, [R, L], order=True).collect()
    assert [(r["label"], r["position"]) for r in got] == [(">a", 8), (">b", 48)]


def test_tiles(spark):
    df = spark.createDataFrame([(50, 0, 3), (50, 0, 4), (50, 0, 8), (29, 0, 2), (16, 10, 2)], "n int, padding int, div int")
    got = df.select("*", F.transform(s.tiles(F.repeat(F.lit("A"), F.col("n")), F.col("padding"), F.col("div")), F.length).alias("t")).collect()
    assert [r["t"] for r in got] == [[16, 16, 18], [12, 12, 12, 14], [6] * 7 + [8], [14, 15], [16]]


def test_chains(spark):
    rows = [([[10, 40], [], [20, 30, 60], [35, 44, 99]],), ([[10], [50], [20]],)]
    got = [r[0] for r in spark.createDataFrame(rows, "h array<array<int>>").select(s.chains(F.col("h"))).collect()]
    assert got == [[[10, -1, 20, 35], [10, -1, 20, 44], [10, -1, 30, 35], [10, -1, 30, 44]], []]


def test_find_and_suffixes(spark):
    refs = spark.createDataFrame([("a", "AAAA"), ("b", "banana")], "ref_id string, seq string")
    want = spark.createDataFrame([(1, "AA"), (2, ""), (3, None)], "pattern_id int, pattern string")
    assert sorted(r["pos"] for r in exact_find(refs, want, 2).collect()) == [0, 1, 2]
    assert [r["start"] for r in suffix_order(refs).filter("ref_id = 'b'").orderBy("rank").collect()] == [6, 5, 3, 1, 0, 4, 2]


def test_ranked(spark):
    rows = [(None if i % 7 == 0 else i * 37 % 50, i) for i in range(400)]
    df = spark.createDataFrame(rows, "position int, read_idx long")
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    got = sorted((r["rank"], r["position"], r["read_idx"]) for r in ranked(df, "position", "read_idx").collect())
    assert got == [(i, *r) for i, r in enumerate(want)]
    assert ranked(df.limit(0), "position", "read_idx").collect() == []


def parts_of(spark, rows, size):
    """Whole sequences as parts of ``size`` bases."""
    return spark.createDataFrame([(r, i, t[i : i + size]) for r, t in rows for i in range(0, len(t), size)], "ref_id string, from long, part string")


def test_parts_equal_whole_sequences(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choices("ACGT", k=n))) for k, n in (("a", 1), ("b", 700), ("c", 64), ("d", 65), ("e", 2000))]
    whole = spark.createDataFrame([*rows, ("n", None), ("o", "")], "ref_id string, seq string")
    for size, over in ((64, 0), (64, 30), (64, 200), (1000, 7)):
        want = sorted((r, i // size, i, t[i : i + size + over]) for r, t in rows for i in range(0, len(t), size))
        assert sorted(map(tuple, refs_op.cut(whole, size, over).collect())) == want
        for part in (1, 50, 64, 999):
            assert sorted(map(tuple, refs_op.cut(parts_of(spark, rows[:4] if part == 1 else rows, part), size, over).collect())) == [w for w in want if part > 1 or w[0] != "e"]
    assert sorted(map(tuple, refs_op.lengths(parts_of(spark, rows, 50)).collect())) == sorted((r, len(t)) for r, t in rows)
    assert refs_op.cut(whole.limit(0), 64, 5).collect() == [] == refs_op.cut(parts_of(spark, rows, 50).limit(0), 64, 5).collect()


def test_windows(spark):
    """Intervals of all sizes, many at one place, and what has no window."""
    rng = random.Random(4)
    rows = {"a": "".join(rng.choices("ACGT", k=5000)), "b": "ACGT" * 20}
    asked = [(i, rng.choice("ab"), rng.randint(0, 4900), rng.choice([1, 9, 100, 3000])) for i in range(200)]
    asked += [(1000 + i, "a", 777, 20) for i in range(500)] + [(2000, None, 0, 5), (2001, "x", 0, 5), (2002, "b", 80, 5)]
    df = spark.createDataFrame(asked, "i int, ref_id string, start int, n int")
    want = {i: rows[r][s : s + n] for i, r, s, n in asked if r in rows and s < len(rows[r])}
    for refs in (spark.createDataFrame(list(rows.items()), "ref_id string, seq string"), parts_of(spark, rows.items(), 333)):
        got = refs_op.windows(df, refs, "start", "n", ["i"], least=64).collect()
        # What lies behind the end in the last block has an empty window.
        assert {r["i"]: r["window"] for r in got if r["window"]} == want and len(got) == len({r["i"] for r in got})
    assert refs_op.windows(df.limit(0), refs, "start", "n", ["i"]).collect() == []


def planted(rng, size):
    """Pairs of reads of one reference: equal, changed, with indels, foreign, of N, null and short ones."""
    ref = "".join(rng.choices("ACGT", k=size))
    reads = []
    for _ in range(60):
        for at in (a := rng.randint(0, size - 200), a + rng.randint(60, 120)):
            x = ref[at : at + rng.randint(30, 50)]
            k = rng.randint(3, len(x) - 3)
            x = rng.choice([x, x, x[:k] + rng.choice("ACGT") + x[k + 1 :], x[:k] + x[k + 2 :], x[:k] + "GA" + x[k:], "".join(rng.choices("ACGT", k=40)), "N" * 40])
            reads.append(x)
    reads += [None, ref[5:50], "", ref[5:50], ref[7:12], ref[5:50]]
    return ref, [("r", i, i // 2, i % 2, x) for i, x in enumerate(reads)]


@pytest.fixture(scope="module")
def mapped(spark):
    ref, reads = planted(random.Random(8), 9000)
    df = spark.createDataFrame(reads, "ref_id string, read_idx long, pair_id long, mate int, seq string").repartition(3)
    rows = lambda out: {r["read_idx"]: r["mapping"] for r in out.collect()}
    summary = Summary()
    whole = spark.createDataFrame([("r", ref)], "ref_id string, seq string")
    out = map_reads(df, whole, summary=summary)  # a stored table
    return df, ref, whole, rows(out), summary, rows, out


def test_rounds_on_the_residue_equal_one_round(spark, mapped):
    df, ref, whole, want, few, rows, _ = mapped
    assert len(few.rounds) == 2 and few.rounds[1][0] == 1
    many = Summary()
    assert rows(map_reads(df, whole, small=0, summary=many)) == want
    sought = [n for _, _, n in many.rounds]
    assert len(sought) > 3 and sought == sorted(sought, reverse=True) and sought[1] < sought[0] / 2
    assert (few.reads, few.mapped) == (many.reads, many.mapped) == (len(want), sum(m is not None for m in want.values()))
    assert 60 < few.mapped < few.reads


def test_a_reference_in_parts_maps_alike(spark, mapped):
    """One reference of several blocks, cut anywhere; nothing is dealt out by the reference alone."""
    df, ref, whole, want, _, rows, out = mapped
    parts = parts_of(spark, [("r", ref)], 1234)
    other = map_reads(df, parts)
    assert rows(other) == want
    calls = [spark.createDataFrame(mutations(m, x).collect(), "ref_id string, position int, type string, new_base string, n long") for m, x in ((out, whole), (other, parts))]
    a, b = (sorted(map(tuple, c.collect())) for c in calls)
    assert a == b and {t for _, _, t, _, _ in a} == {"S", "I", "D"}
    got = [sorted(map(tuple, mutation_lines(c, x).collect())) for c, x in zip(calls, (whole, parts))]
    assert got[0] == got[1] and len(got[0]) == len(a)


def test_no_exchange_on_the_reference_alone(spark, mapped):
    df, ref, whole, *_ = mapped
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = parts_of(spark, [("r", ref)], 1234)
        tried = attempts(df, range(1))
        plans = [p._jdf.queryExecution().executedPlan().toString() for p in (read_roots(tried, parts), place_chains(read_roots(tried, parts), parts, 40), whole_alignment(df, parts, 40, AlignConfig(chunk=2000)))]
        for plan in plans:
            keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
            assert keys and not any(re.fullmatch(r"ref_id#\d+, \d+", k) for k in keys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_paths_equal_the_fold(spark):
    rng = random.Random(6)
    rows = [([sorted(rng.sample(range(60), rng.randint(0, 5))) for _ in range(rng.randint(1, 5))],) for _ in range(150)] + [([[]],), ([[], []],), (None,), ([[3], [], [9]],)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h array<array<int>>")
    want = [(r["i"], j, c) for r in df.select("i", s.chains(F.col("h")).alias("c")).collect() for j, c in enumerate(r["c"] or [])]
    assert sorted((r["i"], r["chain_idx"], r["chain"]) for r in streamed_chains(df, ["i"], "h").collect()) == want
    count = {r["i"]: r["n"] for r in df.select("i", s.chain_count(F.col("h")).alias("n")).collect()}
    assert {i: n for i, n in count.items() if n} == {i: sum(w[0] == i for w in want) for i in {w[0] for w in want}}


def test_very_many_paths_are_counted_and_streamed(spark):
    """Twelve tiles of five places each: 244 million chains, of which the first ones come at once."""
    hits = [list(range(k * 5, k * 5 + 5)) for k in range(12)]
    began = time.time()
    assert sum(ways(hits, 100)[0]) == 5**12
    first = list(islice(paths(hits, 100), 3000))
    assert time.time() - began < 1 and first == sorted(first) and len({tuple(x) for x in first}) == 3000
    dead = [*hits, [10_000]]
    assert list(paths(dead, 100)) == [] and time.time() - began < 1
    df = spark.createDataFrame([(1, hits)], "i int, h array<array<int>>")
    assert df.select(s.chain_count(F.col("h"), 100).alias("n")).first()["n"] == 5**12


def test_whole_alignment_in_chunks(spark):
    """Chunks of a reference in parts, with indels and many groups of reads, equal one alignment of each read."""
    rng = random.Random(12)
    ref = "".join(rng.choices("ACGT", k=1500))
    reads = []
    for i in range(40):
        a = rng.randint(0, 1440)
        x = ref[a : a + 40]
        reads.append(("r", i, rng.choice([x, x[:20] + x[23:], x[:20] + "TT" + x[20:], x[:9] + "A" + x[10:]])))
    reads += [("r", 90, None), ("r", 91, ""), ("x", 92, "ACGT"), (None, 93, "ACGT")]
    df = spark.createDataFrame(reads, "ref_id string, read_idx long, seq string")
    parts, config = parts_of(spark, [("r", ref)], 400), AlignConfig(chunk=500)
    got = {r["read_idx"]: r["mapping"] for r in whole_alignment(df, parts, 40, config, together=1).collect()}
    size, step = len(ref), 500 - 80
    for key, i, x in reads:
        if key != "r" or not x:
            assert got[i] is None
            continue
        each = [(m.errors(), a, m) for a in range(0, size, step) if (m := align(Window(ref, 0, size), x, a, min(a + 500, size), config.max_gap))]
        best = min(each, key=lambda e: e[:2])[2]
        assert got[i].asDict(recursive=True) == best.row()
    assert len(got) == len(reads) and whole_alignment(df.limit(0), parts, 40, config).collect() == []


def test_short_references_go_to_their_reads(spark, monkeypatch):
    """One pass over all attempts, with nothing written between reads and mappings, gives what the rounds give."""
    rng = random.Random(12)
    refs, reads = [], []
    for r in range(3):
        ref, some = planted(rng, [900, 1900, 2600][r])
        ref += ref[: rng.choice([0, 300])]
        refs.append((f"r{r}", ref))
        reads += [(f"r{r}", 1000 * r + i, 500 * r + p, m, x) for _, i, p, m, x in some]
    reads += [(None, 90000, 45000, 0, "ACGT" * 10), ("none", 90001, 45000, 1, "ACGT" * 10)]
    reads = spark.createDataFrame(reads, "ref_id string, read_idx long, pair_id long, mate int, seq string").repartition(3)
    whole = spark.createDataFrame(refs, "ref_id string, seq string")
    made = []
    monkeypatch.setattr(mapping, "written", lambda df, label: made.append(label) or written(df, label))
    rows = lambda: {r["read_idx"]: r["mapping"] for r in map_reads(reads, whole).collect()}
    got = rows()
    assert "map-roots" not in made and "map-attempts" not in made
    monkeypatch.setattr(mapping, "NEAR", 2000)  # some references either way
    both = rows()
    monkeypatch.setattr(mapping, "NEAR", 0)
    assert got == both == rows() and 150 < sum(m is not None for m in got.values()) < len(got)
    assert "map-roots" in made


def test_tiles_of_a_held_read(spark):
    rows = [("ACGTTGCA" * 9)[:n] for n in range(16, 60)]
    df = spark.createDataFrame([("r", i, i, 0, x) for i, x in enumerate(rows)], "ref_id string, read_idx long, pair_id long, mate int, seq string")
    want = {(r["read_idx"], r["attempt"]): r["parts"] for r in attempts(df, range(11)).collect()}
    assert want == {(i, a): t for i, x in enumerate(rows) for a, t in mapping.tries(x)}
    assert occurrences("AA", "AAATAA") == [0, 1, 4] and occurrences("C", "AAA") == []


def test_unchanged_reads_are_placed_by_search(spark):
    """What the search decides equals the alignment of all chunks; a chunk in which nothing fits leaves it open."""
    rng = random.Random(31)
    text = "".join(rng.choices("ACGT", k=700))
    refs = [("a", text), ("n", "N" * 420 + text), ("t", text[:100] + "N" * 400 + text[:300])]
    reads = [(r, i * 10 + k, x) for k, (r, t) in enumerate(refs) for i, x in enumerate([t[450:490], t[10:60], t[10:30] + "T" + t[31:60], t[640:680], "AC", "N" * 9])]
    df = spark.createDataFrame(reads, "ref_id string, read_idx long, seq string")
    whole, config = spark.createDataFrame(refs, "ref_id string, seq string"), AlignConfig(chunk=300)
    equal = {r["read_idx"]: r["mapping"] for r in mapping.equal_places(mapping.chunk_pairs(df, whole, 40, config, 4, False), config).collect()}
    got = {r["read_idx"]: r["mapping"] for r in whole_alignment(df, whole, 40, config).collect()}
    for r, i, x in reads:
        t = dict(refs)[r]
        each = [(m.errors(), a, m) for a in range(0, len(t), 220) if (m := align(Window(t, 0, len(t)), x, a, min(a + 300, len(t)), config.max_gap))]
        want = min(each, key=lambda e: e[:2])[2].row()
        assert got[i].asDict(recursive=True) == want and (i not in equal or equal[i].asDict(recursive=True) == want)
    assert {0, 10, 30} <= set(equal) and not {1, 31, 20} & set(equal)
