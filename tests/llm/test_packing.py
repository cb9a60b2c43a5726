import random
import zlib
from collections import Counter, defaultdict

import pytest

from strandloom.llm import packing as p

SCHEMA = "doc_id long, text string, size string, shard int, group string"


def plain_best_fit(sizes, bins, capacity):
    left, out = [], []
    for s in sizes:
        fits = [(r, b) for b, r in enumerate(left) if r >= s]
        if not fits:
            if len(left) == bins or s > capacity:
                return None
            left.append(capacity)
            fits = [(capacity, len(left) - 1)]
        b = min(fits)[1]
        left[b] -= s
        out.append(b)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_counts_pack_like_single_groups(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.choice([1, 1, 2, rng.randint(1, 9), rng.randint(1, 200)]) for _ in range(rng.randint(1, 200))), reverse=True)
    bins, capacity = rng.randint(1, 9), rng.randint(1, 2 * sum(sizes))
    kinds = sorted(Counter(sizes).items(), reverse=True)
    got = p.best_fit([s for s, _ in kinds], [n for _, n in kinds], bins, capacity)
    want = plain_best_fit(sizes, bins, capacity)
    assert (got and [b for _, n, b in got for _ in range(n)]) == want
    if got:
        assert [a for a, _, _ in got] == [sum(n for _, n, _ in got[:k]) for k in range(len(got))]


def loads(sizes, bins):
    kinds = sorted(Counter(sizes).items(), reverse=True)
    out = [0] * bins
    order = sorted(sizes, reverse=True)
    for a, n, b in p.pack([s for s, _ in kinds], [n for _, n in kinds], bins):
        out[b] += sum(order[a : a + n])
    return out


def test_pack():
    assert loads([], 4) == [0] * 4 and sorted(loads([5], 4)) == [0, 0, 0, 5]
    assert sorted(loads([100, 100, 1, 1, 1, 1], 4)) == [2, 2, 100, 100]
    assert sorted(loads([7] * 8, 4)) == [14] * 4
    assert sorted(loads([10] * 5, 4)) == [0, 10, 20, 20]  # one capacity for all
    rng = random.Random(1)
    sizes = [int(rng.paretovariate(1.1) * 50) for _ in range(5000)]
    got = loads(sizes, 16)
    fair = sum(x for x in sizes if x < sum(sizes) / 16) / 16
    assert sum(got) == sum(sizes) and min(got) > 0.98 * min(fair, sorted(got)[8])


def test_tree_keeps_order():
    rng, tree, held = random.Random(3), p.Remaining(), set()
    for _ in range(3000):
        key = (rng.randint(0, 40), rng.randint(0, 500))
        if key in held and rng.random() < 0.7:
            tree.remove(key)
            held.discard(key)
        elif key not in held:
            tree.add(*key)
            held.add(key)
        size = rng.randint(0, 45)
        assert tree.tightest(size) == min((k for k in held if k[0] >= size), default=None)


def some():
    rng = random.Random(4)
    texts = ["x" * rng.randint(0, 60) + rng.choice("aé") for _ in range(300)] + ["hot copy"] * 200 + [None, "", "", "long " * 900]
    return [(rng.choice([i, i, i, 7, None]), t, "s", 1, "g") for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [1 << 16, 8])
def test_shards(spark, monkeypatch, block):
    monkeypatch.setattr(p, "BLOCK", block)
    rows = some()
    got = p.packed_shards(spark.createDataFrame(rows, SCHEMA).repartition(5), 6).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(raw(t)) + 1, zlib.crc32(raw(t))) for i, t, *_ in rows)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    shard, slots, sums = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        shard[r["size"], r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        sums[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in shard.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for _, t, *_ in rows:
        groups[raw(t)] += len(raw(t)) + 1
    kinds = sorted(Counter(groups.values()).items(), reverse=True)
    want, order = Counter(), sorted(groups.values(), reverse=True)
    for a, n, b in p.pack([s for s, _ in kinds], [n for _, n in kinds], 6):
        want[b] += sum(order[a : a + n])
    assert +sums == +want
    again = p.packed_shards(spark.createDataFrame(rows, SCHEMA).repartition(2), 6).collect()
    assert Counter(r for r in again) == Counter(got)


def test_no_rows(spark):
    assert p.packed_shards(spark.createDataFrame([], SCHEMA)).collect() == []
    one = p.packed_shards(spark.createDataFrame([(None, None, "", 0, "")], SCHEMA)).collect()
    assert [(r["doc_id"], r["size"], r["text_crc32"], r["slot"]) for r in one] == [(None, 1, 0, 0)]
