import bisect
import random

from pyspark.sql import functions as F

from strandloom.__main__ import arguments
from strandloom.config import AlignConfig
from strandloom.functions import sequence as s
from strandloom.operators import find, pairs, pileup
from strandloom.operators.kernel import Mapping, Window, drawn
from strandloom.plans import registry
from strandloom.plans.mapping import chunks, map_reads, mutations, read_mappings, whole_alignment
from strandloom.sources.text import read_reads


def test_find_equals_plain_search(spark):
    """Patterns of any length, repeated and null ids, repeated rows, null and empty strings."""
    rng = random.Random(1)
    text = lambda n, letters="ACGT": "".join(rng.choices(letters, k=n))
    refs = [(i, text(n)) for i, n in enumerate([0, 1, 5, 40, 300, 700, 1500])] + [(9, "ACGT" * 90), (9, "ACGT" * 90), (None, "AAAA" * 30), (10, None)]
    long = refs[6][1]
    patterns = [(k, long[a : a + n]) for k, (a, n) in enumerate([(0, 1), (3, 2), (9, 7), (250, 16), (255, 30), (500, 33), (100, 64), (700, 800), (1499, 1)])]
    patterns += [(20, "ACGTACGT"), (20, "ACGTACGT"), (None, "AAAAA"), (21, ""), (22, None), (23, text(50))]
    want = sorted(((r, p, i) for r, t in refs for p, x in patterns if t and x for i in range(len(t)) if t.startswith(x, i)), key=str)
    a, b = spark.createDataFrame(refs, "ref_id int, seq string"), spark.createDataFrame(patterns, "pattern_id int, pattern string")
    for k in (16, 4):
        assert sorted(map(tuple, find.exact_find(a, b, k).collect()), key=str) == want
    with_ref = spark.createDataFrame([(r, p, x) for r in (5, 9, None) for p, x in patterns], "ref_id int, pattern_id int, pattern string")
    got = find.exact_find(a, with_ref, by_ref=True).collect()
    assert sorted(map(tuple, got), key=str) == [w for w in want if w[0] in (5, 9, None)]
    assert find.exact_find(a, b.limit(0)).collect() == [] and find.exact_find(a.limit(0), b).collect() == []


def test_nearest_ahead_equals_all_pairs(spark):
    rng = random.Random(2)
    left = [(rng.choice("abc"), i, rng.choice([None, *range(0, 3000, 7)])) for i in range(150)] + [(None, 500, 1)]
    right = [(rng.choice("abcd"), i, rng.choice([None, *range(0, 3000, 5)])) for i in range(150)] + [(None, 500, 9)]
    best = {}
    for k, i, a in left:
        for m, j, b in right:
            if k == m and k and a is not None and b is not None and b > a:
                best[k] = min(best.get(k, (1 << 60,)), (b - a, i, j))
    got = pairs.nearest_ahead(spark.createDataFrame(left, "k string, ord long, reach int"), spark.createDataFrame(right, "k string, ord long, place int"), "k")
    assert {r["k"]: (r["distance"], r["left_order"], r["right_order"]) for r in got.collect()} == best
    none = spark.createDataFrame([], "k string, ord long, reach int")
    assert pairs.nearest_ahead(none, none.withColumnRenamed("reach", "place"), "k").collect() == []


def test_first_success(spark):
    rows = [("a", 2, 1, True), ("a", 1, 2, False), ("a", 3, 3, True), ("a", 2, 4, True), ("b", 1, 5, False), (None, 1, 6, True), ("c", None, 7, True)]
    got = pairs.first_success(spark.createDataFrame(rows, "k string, turn int, id int, ok boolean"), "k", "turn", "ok")
    assert sorted(r["id"] for r in got.collect()) == [1, 4]


def test_depth_over_regions(spark, monkeypatch):
    monkeypatch.setattr(pileup, "REGION", 10)
    rng = random.Random(3)
    rows = [(rng.choice([1, 2]), a := rng.randint(0, 90), a + rng.randint(0, 40)) for _ in range(60)] + [(None, 1, 2), (1, None, 5)]
    at = [(1, p) for p in range(0, 140, 3)]
    df = spark.createDataFrame(rows, "ref_id int, start int, end int")
    got = {(r["ref_id"], r["position"]): r["depth"] for r in pileup.depth(df, ["ref_id"], spark.createDataFrame(at, "ref_id int, position int")).collect()}
    assert {k for k in got} == {(r, p) for r, a, b in rows if r and a is not None for p in (a, b)} | set(at)
    assert all(n == sum(r == k and a <= p < b for k, a, b in rows if k and a is not None) for (r, p), n in got.items())


def test_votes_of_one_read(spark):
    cases = {
        "insertion": ([], [("I", 15, 2)], [(14, "I", "F"), (15, "I", "G")]),
        "deletion before": ([], [("D", 12, 2), ("I", 18, 1)], [(12, "D", None), (13, "D", None), (17, "I", "K")]),
        "both": ([(14, "X")], [("D", 14, 1)], [(14, "D", None), (14, "S", "X")]),
    }
    for wrong, gaps, want in cases.values():
        df = spark.createDataFrame([("r", 1, "ABCDEFGHIJKLMNOPQRST", (10, wrong, gaps), 100)], f"ref_id string, read_idx long, seq string, mapping {s.MAPPING}, ref_length int")
        got = pileup.read_mutations(pileup.active(df, s.length_adjust(), F.col("ref_length"))).collect()
        assert sorted(((r["position"], r["type"], r["new_base"]) for r in got), key=str) == want


def test_text_forms(spark):
    df = spark.createDataFrame([((7, [(9, "A")], [("I", 8, 2)]),), ((-1, [], []),)], f"mapping {s.MAPPING}")
    assert [r[0] for r in df.select(s.mapping_text()).collect()] == ["7 S9:A,I8:2", "-1 "]
    values = spark.createDataFrame([([1.0, 3.0, 3.0], 3.0), ([], 1.0), ([1.0], 2.0)], "v array<double>, x double")
    assert [r[0] for r in values.select(s.insertion_point(F.col("v"), F.col("x"))).collect()] == [1, 0, 1]


def test_chunks(spark):
    size = spark.createDataFrame([(250_000,), (100_000,), (0,)], "n int")
    got = [[c["left"] for c in r[0]] for r in size.select(chunks(F.col("n"), 50)).collect()]
    assert got == [[0, 99900, 199800], [0], [0]]
    got = [[c["left"] for c in r[0]] for r in spark.createDataFrame([(199_850,)], "n int").select(chunks(F.col("n"), 50, skip_covered_tail=True)).collect()]
    assert got == [[0, 99900]]


def test_whole_alignment_in_chunks(spark):
    rng = random.Random(4)
    ref = "".join(rng.choices("ACGT", k=600))
    reads = [(i, ref[a : a + 30]) for i, a in enumerate([0, 95, 333, 570])] + [(9, None), (10, "")]
    rows = spark.createDataFrame([("r", i, t) for i, t in reads], "ref_id string, read_idx long, seq string")
    got = whole_alignment(rows, spark.createDataFrame([("r", ref)], "ref_id string, seq string"), 30, AlignConfig(chunk=200), together=2).collect()
    assert {r["read_idx"]: r["mapping"] and r["mapping"]["position"] for r in got} == {0: 0, 1: 95, 2: 333, 3: 570, 9: None, 10: None}


def test_a_failed_read_unmaps_its_pair(spark):
    """The second tile begins before the first ends, so the window between them has a negative size."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("ACGT", k=n))
    a, b, mate = text(16), text(16), text(40)
    ref = text(60) + a[:4] + a[4:12] + a[12:] + text(70) + mate + text(50)
    at = ref.index(a)
    read = a + "".join("ACGT"[("ACGT".index(c) + 1) % 4] for c in b) + ref[at + 5 : at + 21] + "AC"
    reads = spark.createDataFrame([("r", 0, 0, 0, read), ("r", 1, 0, 1, mate), ("r", 2, 1, 0, a + text(0) + ref[at + 16 : at + 40]), ("r", 3, 1, 1, mate)], "ref_id string, read_idx long, pair_id long, mate int, seq string")
    got = {r["read_idx"]: r["mapping"] and r["mapping"]["position"] for r in map_reads(reads, spark.createDataFrame([("r", ref)], "ref_id string, seq string")).collect()}
    assert got == {0: None, 1: None, 2: at, 3: ref.index(mate)}


def test_reads_of_several_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">1\nAC\r\n>2\n\n>3\nGG\n")
    (tmp_path / "in" / "b.fa").write_text(">4\nTT\n>5")
    (tmp_path / "in" / "c.fa").write_text("")
    got = read_reads(spark, str(tmp_path / "in")).orderBy("read_idx").collect()
    assert [(r["read_idx"], r["pair_id"], r["mate"], r["label"], r["seq"]) for r in got] == [(0, 0, 0, ">1", "AC\r"), (1, 0, 1, ">2", ""), (2, 1, 0, ">4", "TT"), (3, 1, 1, ">5", "")]


def test_lines_of_many_parts(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    (tmp_path / "r.fa").write_text("".join(f">{i}\n{'ACGT' * (i % 9)}\n" for i in range(200)))
    try:
        got = read_reads(spark, str(tmp_path / "r.fa")).orderBy("read_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["label"], len(r["seq"])) for r in got] == [(f">{i}", 4 * (i % 9)) for i in range(200)]


def test_written_lines_and_arguments(spark, tmp_path):
    assert arguments(["r"]) is None and arguments(["a", "b", "c", "d", "e"]) is None
    assert arguments(["a", "b"]) == ("a", "b", "output/mappings.txt", False)
    assert arguments(["a", "b", "-m", "o"]) == ("a", "b", "o", True) and arguments(["a", "b", "c", "d"]) == ("a", "b", "d", False)


def test_insertion_point_by_halves(spark):
    rng = random.Random(9)
    rows = [(i, sorted(rng.randint(0, 40 + 4 * n) for _ in range(n)), rng.randint(-3, 60 + 4 * n)) for i, n in enumerate([0, 1, 2, 31, 32, 33, 64, 65, 100, 127, 128, 129, 700] * 6)]
    rows += [(1000, list(range(100)), None), (1001, None, 5), (1002, [7] * 80, 7), (1003, [7] * 80, 8)]
    df = spark.createDataFrame(rows, "i int, xs array<int>, x int")
    got = {r["i"]: r["p"] for r in df.select("i", s.insertion_point(F.col("xs"), F.col("x")).alias("p")).collect()}
    for i, xs, x in rows:
        if xs is not None and x is not None:
            assert got[i] == bisect.bisect_left(xs, x), (i, x)
    assert got[1000] == 0 and got[1001] is None


def test_hot_key_with_an_outlier_is_cut_evenly(spark):
    """Places of a hot key lie close together but for one far away; parts follow its rows, not the range."""
    rng = random.Random(10)
    places = [rng.randint(0, 50_000) for _ in range(6000)] + [10**15]
    df = spark.createDataFrame([("hot", p) for p in places] + [(f"k{i}", i) for i in range(300)], "k string, at long")
    parts = {(r["k"], r["part"]): r["n"] for r in pairs.place_ranges(df, "k", "at").groupBy("k", "part").agg(F.count("*").alias("n")).collect()}
    assert max(parts.values()) < 200 and len(parts) > 200 + 300
    left = [("hot", i, p) for i, p in enumerate(places[:3000])] + [("one", 1, 5), ("one", 0, 5)]
    right = [("hot", i, p + 3) for i, p in enumerate(places[3000:])] + [("one", 8, 7), ("one", 7, 7), ("one", 6, 5)]
    a, b = spark.createDataFrame(left, "k string, ord long, reach long"), spark.createDataFrame(right, "k string, ord long, place long")
    got = {r["k"]: (r["distance"], r["left_order"], r["right_order"]) for r in pairs.nearest_ahead(a, b, "k").collect()}
    want = min((p - q, i, j) for k, i, q in left[:3000] for j, p in ((x[1], x[2]) for x in right[:3001]) if p > q)
    assert got == {"hot": want, "one": (2, 0, 7)}
    assert pairs.nearest_ahead(a.limit(0), b, "k").collect() == []


def test_alignment_view_equals_the_drawn_lines(spark):
    rng = random.Random(11)
    rows, want = [], []
    for i in range(120):
        ref = "".join(rng.choices("ACGT", k=60))
        at = rng.randint(-2, 55)
        read = "".join(rng.choices("ACGT", k=rng.randint(1, 30)))
        indels = sorted({p: (rng.choice("DI"), p, rng.randint(1, 5)) for p in rng.sample(range(max(at, 0), 70), 3)}.values(), key=lambda x: x[1])
        rows.append((i, ref, read, {"position": at, "mismatches": [], "indels": [{"type": t, "position": p, "length": n} for t, p, n in rng.sample(indels, 3)]}))
        top, low = drawn(Window(ref, 0, 60), read, Mapping(at, {}, indels), 0)
        want.append((i, top.replace("\0", "."), low))
    rows.append((999, None, "ACGT", None))
    view = spark.createDataFrame(rows, f"i int, ref string, seq string, mapping {s.MAPPING}").select("i", "ref", "seq", s.alignment_view(F.col("ref"), F.col("seq")).alias("v"))
    got = view.select("*", s.ungapped(F.col("v.low")).alias("read")).orderBy("i").collect()
    assert [(r["i"], r["v"]["top"], r["v"]["low"]) for r in got[:-1]] == want and got[-1]["v"] is None
    assert all(r["read"] == r["seq"] for r in got[:-1])


def test_suffix_order_by_doubling(spark):
    """Repeats of all lengths, runs of one letter, whole sequences and parts; against the plain order."""
    rng = random.Random(13)
    text = lambda n, letters="ACGT": "".join(rng.choices(letters, k=n))
    again = text(200)
    rows = [("a", ""), ("b", "A"), ("c", "A" * 300), ("d", again + text(30) + again + "G" + again[:90]), ("e", "banana"), ("f", text(500, "AB")), ("g", "é" * 40 + "zéa"), ("h", text(700))]
    want = {(k, r, i) for k, t in rows for r, i in enumerate(sorted(range(len(t) + 1), key=lambda i: t[i:].encode()))}
    refs = spark.createDataFrame([*rows, ("n", None), (None, "AC")], "ref_id string, seq string")
    got = find.suffix_order(refs).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    parts = spark.createDataFrame([(k, i, t[i : i + 37]) for k, t in rows for i in range(0, len(t), 37)], "ref_id string, from long, part string")
    assert {tuple(r) for r in find.suffix_order(parts).collect()} == {w for w in want if w[0] != "a"}
    asked = [(1, "A"), (2, again[:50]), (3, "an"), (4, "nowhere")]
    hits = find.exact_find(refs, spark.createDataFrame(asked, "pattern_id int, pattern string"))
    found = {tuple(r) for r in find.suffix_bounds(find.suffix_order(refs), hits).collect()}
    plain = set()
    for k, t in rows:
        order = sorted(t[i:] for i in range(len(t) + 1))
        for p, x in asked:
            if x in t:
                plain.add((k, p, bisect.bisect_left(order, x), bisect.bisect_left(order, x) + sum(s.startswith(x) for s in order)))
    assert found == {f for f in plain if f[0] != "g"}
    assert find.suffix_order(refs.limit(0)).collect() == []


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    reads = none("ref_id string, read_idx long, pair_id long, mate int, seq string")
    refs, maps = none("ref_id string, seq string"), none(f"pair_id long, mate int, read_idx long, map_idx long, mapping {s.MAPPING}")
    mapped = none(f"ref_id string, read_idx long, seq string, mapping {s.MAPPING}")
    votes = none("k string, c string, o int")
    for out in (
        pileup.depth(none("k string, start int, end int"), ["k"]),
        pileup.majority(votes, ["k"], ["c"], ["o"], none("k string, total long")),
        mutations(mapped, refs), map_reads(reads, refs), read_mappings(reads, refs), whole_alignment(reads, refs, 20),
        pairs.select_pairs(maps, s.length_adjust()), pairs.first_success(votes, "k", "o", "c = 'x'"),
        find.seed_hits(none("pattern_id int, pattern string"), refs), find.suffix_order(refs), pileup.mapping_order(none("label string, position int, read_idx long")),
        pileup.mutation_lines(none("ref_id string, position int, type string, new_base string"), refs),
    ):
        assert out.collect() == []


def test_equal_mappings_and_mutations(spark):
    one = {"position": 3, "mismatches": [{"position": 5, "new_base": "A"}, {"position": 4, "new_base": "C"}], "indels": [{"type": "D", "position": 9, "length": 2}]}
    other = one | {"mismatches": one["mismatches"][::-1]}
    wrong = [one | {"position": 4}, one | {"indels": []}, one | {"mismatches": [{"position": 5, "new_base": "G"}, {"position": 4, "new_base": "C"}]}, one | {"indels": [{"type": "I", "position": 9, "length": 2}]}, None]
    rows = [(one, other, True), (None, None, True), *[(one, w, False) for w in wrong]]
    df = spark.createDataFrame(rows, f"a {s.MAPPING}, b {s.MAPPING}, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", s.same_mapping(F.col("a"), F.col("b")).alias("got")).collect())
    keys = spark.createDataFrame([("D", 1, "A"), ("D", 1, None), ("I", 1, "A"), ("I", 1, "C"), ("S", 1, "A")], "t string, p int, b string")
    assert keys.select(s.mutation_key(F.col("t"), F.col("p"), F.col("b")).alias("k")).distinct().count() == 4


def test_no_gap_in_a_chain_is_above_the_limit(spark):
    rng = random.Random(14)
    rows = [([sorted(rng.sample(range(120), rng.randint(0, 4))) for _ in range(5)],) for _ in range(600)]
    got = spark.createDataFrame(rows, "h array<array<int>>").select(F.explode(s.chains(F.col("h"))).alias("c")).collect()
    found = [[p for p in r["c"] if p >= 0] for r in got]
    assert len(found) > 100 and all(0 < b - a <= 25 for c in found for a, b in zip(c, c[1:]))


def test_short_suffixes_without_a_shuffle(spark):
    refs = spark.createDataFrame([(1, "banana"), (2, ""), (3, "é" * 30 + "zéa")], "ref_id int, seq string")
    got = find.suffix_order(refs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r["start"] for r in got.filter("ref_id = 1").orderBy("rank").collect()] == [6, 5, 3, 1, 0, 4, 2]


def test_suffixes_of_documents_that_hold_an_item(spark, sf_dir, monkeypatch):
    """Documents without an item have no row, so their suffixes need no order."""
    seen = []
    monkeypatch.setattr(registry, "suffix_order", lambda refs: seen.append(refs.count()) or find.suffix_order(refs))
    held = {r["ref_id"] for r in registry.suffix_ranges(spark, sf_dir).collect()}
    assert seen == [len(held)] and held
