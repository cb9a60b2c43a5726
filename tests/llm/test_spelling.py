import random
import re
import zlib
from collections import Counter

import pytest

from strandloom.llm import spelling as s

SCHEMA = "doc_id long, text string, n int, word string, key int"


def slow(rows):
    count = Counter()
    for i, text, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    return with_forms(words)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def with_forms(words):
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def typo(rng, w):
    i, c = rng.randrange(len(w) + 1), rng.choice("abcéÿÀ")
    return rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w])


def some(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa"]
    words = list(base)
    for _ in range(5):
        words += [typo(rng, w) for w in words[:80]]
    rows = [(rng.choice([i, i, 3, None]), " ".join(rng.choice([w, w, w.upper()]) for w in rng.choices(words, k=rng.randint(0, 60))), 1, "w", 2) for i in range(300)]
    return rows + [(900, None, 0, "", 0), (901, "", 0, "", 0), (902, "1234 - Āā " + "Don't stop-Stop " * 4, 0, "", 0), (903, " ".join([long, long, long + "z", long + "z", long + "z", long]), 0, "", 0)]


long = "longword" * 5000


def run(spark, rows):
    got = s.spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return [tuple(r) for r in got.collect()]


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rows = some(seed)
    got = run(spark, rows)
    assert len(got) == len(set(got)) > 100 and set(got) == slow(rows)
    assert any(r[2] != (r[1] or r[0]) for r in got)  # a chain of forms


def near_of(words, cut):
    """Counts and best near words from buckets, compared as in a task."""
    best = s.Best()
    buckets = {}
    for w, n in words.items():
        raw = w.encode("latin-1")
        for m in (len(raw), len(raw) + 1):
            for a, b in s.halves(0, m):
                buckets.setdefault((m, a, b), {}).setdefault(s.outside(raw, m, a, b), []).append((raw, n))
    for (m, a, b), found in buckets.items():
        s.compare(m, a, b, list(found.values()), best)
    return {w.decode("latin-1"): (n, best.top[w][1].decode("latin-1")) for w, n in best.count.items()}


@pytest.mark.parametrize(("block", "large"), [(256, 1024), (3, 8), (4, 1), (1, 2)])
def test_blocks_and_cut_buckets(monkeypatch, block, large):
    """Whatever the sizes of blocks and buckets, each pair is found once."""
    monkeypatch.setattr(s, "BLOCK", block)
    monkeypatch.setattr(s, "LARGE", large)
    rng = random.Random(block)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))): rng.randint(1, 5) for _ in range(200)}
    words |= {"abcab" + x + "d" * k: 3 for x in "abcdefgh" for k in range(3)}
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    want = {w: (len(vs), min(vs, key=lambda v: (-words[v], v))) for w, vs in near.items() if vs}
    assert near_of(words, large) == want


def test_heavy_buckets_are_cut(spark, monkeypatch):
    """Words that share all but a few places are dealt anew before any task sees them together."""
    monkeypatch.setattr(s, "LARGE", 40)
    letters = "abcdefghij"
    texts = [f"same{x}{y}same{z}same" for x in letters for y in letters for z in letters[:4]]
    rows = [(1, " ".join(texts * (3 + k)), 0, "", 0) for k in range(2)]
    words = spark.createDataFrame(rows, SCHEMA)
    assert set(run(spark, rows)) == slow(rows)
    first = s.word_counts(words).mapInArrow(s.bucket_rows, s.BUCKETS)
    got = s.split_heavy(first).groupBy("m", "low", "high", "key").count()
    assert got.agg({"count": "max"}).first()[0] <= 40 < first.groupBy("m", "low", "high", "key").count().agg({"count": "max"}).first()[0]


def test_no_rows(spark):
    assert run(spark, [(1, None, 0, "", 0)]) == [] and s.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
