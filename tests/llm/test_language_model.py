import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import language_model as lm
from strandloom.llm.eliasfano import Sequence, encode, files, mapped


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 1 << 40), max_size=200), st.lists(st.integers(0, 1 << 41), max_size=20))
def test_elias_fano(values, others):
    have = np.array(sorted(values), np.int64)
    bits, low, high = encode(have, 32 if len(have) < 50 else None)
    if len(have) and int(have[-1]) >> bits > 1 << 22:
        return
    seq = Sequence(len(have), bits, low, high)
    ask = np.array(sorted(values) + others, np.int64)
    place = {x: i for i, x in enumerate(sorted(values))}
    assert seq.find(ask).tolist() == [place.get(x, -1) for x in ask.tolist()]
    assert seq.get(np.arange(len(have))).tolist() == have.tolist()
    start, stop = np.full(len(ask), len(have) // 3), np.full(len(ask), len(have) // 2)
    assert seq.find(ask, start, stop).tolist() == [i if len(have) // 3 <= (i := place.get(x, -1)) < len(have) // 2 else -1 for x in ask.tolist()]


def test_files_of_wide_and_repeated_values(tmp_path):
    rng = np.random.default_rng(5)
    wide = np.sort(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
    for name, values in {"wide": wide - wide[0], "repeated": np.sort(rng.integers(0, 50, 4000)), "one": np.array([7])}.items():
        for ending, array in files(values).items():
            array.tofile(tmp_path / f"{name}.{ending}")
        seq = mapped(str(tmp_path / name), len(values))
        assert seq.get(np.arange(len(values))).tolist() == values.tolist()
        at = seq.find(values)
        assert (at >= 0).all() and values[at].tolist() == values.tolist()
    assert sum(f.stat().st_size for f in tmp_path.glob("wide.*")) < 7.5 * len(wide)


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [""]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "FILE_ROWS", 5000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r[0], r[1], 0.0) for r in docs] + [(5000, None, 0.0), (5001, "", 0.0), (5002, "The the " * 5000, 0.0), (None, "zzz unseen", 0.0), (5003, "x", 0.0), (5003, "x", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    single, pair, follow = Counter(), Counter(), Counter()
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _, _ in rows}
    for i, t, _ in rows:
        if not held[i]:
            ws = tokens(t)
            single.update(ws)
            pair.update(zip([""] + ws[:-1], ws))
    n, v = sum(single.values()), len(single)
    whole = Counter()
    for (h, _), c in pair.items():
        whole[h] += c
        follow[h] += 1
    n1, n2 = sum(c == 1 for c in pair.values()), sum(c == 2 for c in pair.values())
    d = n1 / (n1 + 2 * n2)
    u = lambda w: (single[w] + 0.5) / (n + 0.5 * (v + 1))
    p = lambda h, w: u(w) if not whole[h] else (max(pair[h, w] - d, 0) + d * follow[h] * u(w)) / whole[h]
    trie = lm.fit(df)
    assert len(trie.pairs) > 1 and trie.n == n and trie.v == v and math.isclose(trie.discount, d)
    got = lm.scores(df, trie).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    for r in got:
        ws = tokens(text[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(single[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10(u(w)) for w in ws), rel_tol=1e-9)
        assert abs(r["score"] - sum(math.log10(p(h, w)) for h, w in zip([""] + ws[:-1], ws))) <= lm.STEP * len(ws)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scores(none, lm.fit(none)).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.scores(one, lm.fit(none)).first()
    assert r["n_known"] == 0 and math.isclose(r["score"], r["base_score"])
