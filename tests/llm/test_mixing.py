import hashlib
import math

from strandloom.llm.mixing import fair_mix, source_targets

SCHEMA = "doc_id long, text string, source string, size int"


def test_targets_by_water_filling(spark):
    rows = [("a", 100), ("b", 900), ("c", 10), ("d", 2000), ("e", 5), (None, 50), ("z", 0)]
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    names = sorted([n for n, _ in rows if n is not None]) + [None]
    weight, size = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}, dict(rows)
    target, free, left = {}, set(names), sum(size.values())
    while free:
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = {n for n in free if share[n] > 3 * size[n]}
        if not over:
            target |= share
            break
        target |= {n: 3 * size[n] for n in over}
        left -= sum(3 * size[n] for n in over)
        free -= over
    assert all(math.isclose(got[n], target[n], abs_tol=1e-6) for n in names)


def test_mix(spark):
    rows = [(i, "w " * (i % 37) + "x", f"s{i % 7}" if i % 3 else "s0", 1) for i in range(3000)] + [(1, "w x", None, 0), (5, None, "s1", 0), (5, None, "s1", 0), (6, "", "s2", 0), (7, "dup dup", "s3", 0), (7, "dup dup", "s3", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = fair_mix(df.repartition(5)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        s = by.setdefault(r["source"], [0, r["target"], r["source_size"]])
        s[0] += r["taken"]
    assert all(abs(s[0] - s[1]) <= 80 for s in by.values())
    total = sum(s[2] for s in by.values())
    assert sum(s[0] for s in by.values()) <= total
    again = fair_mix(df.repartition(2)).collect()
    key = lambda r: (r["doc_id"], r["size"], r["taken"], str(r["source"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_taken_equals_a_plain_queue(spark):
    """Every document's words taken, from its finish time and the order of all of them."""
    rows = [(i, "w " * (i * 7 % 41) + "x", [f"s{i % 5}", "s0", None][i % 3], 1) for i in range(800)]
    got = fair_mix(spark.createDataFrame(rows, SCHEMA)).collect()
    target = {r["source"]: (r["target"], r["source_size"]) for r in got}
    key = {i: hashlib.md5(f"10:{i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest() for i, t, _, _ in rows}
    size = {i: len(t.split()) for i, t, _, _ in rows}
    sent = []
    for source, (words, whole) in target.items():
        done = 0
        for turn in range(3):
            for i in sorted((i for i, _, s, _ in rows if s == source), key=lambda i: key[i]):
                done += size[i]
                if done - size[i] < words:
                    sent.append((done / words, key[i], i))
    taken, total = dict.fromkeys(size, 0), 0
    for _, _, i in sorted(sent):
        total += size[i]
        taken[i] += size[i] if total <= sum(size.values()) else 0
    assert {r["doc_id"]: r["taken"] for r in got} == taken


def test_no_rows(spark):
    assert fair_mix(spark.createDataFrame([], SCHEMA)).collect() == []
    one = fair_mix(spark.createDataFrame([(1, None, "a", 0)], SCHEMA)).collect()
    assert [(r["size"], r["taken"]) for r in one] == [(0, 0)]
