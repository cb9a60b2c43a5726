import hashlib
import random
from collections import Counter

import numpy as np

from strandloom.llm import suffixes
from strandloom.llm.suffixes import without_repeats


def slow(rows):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + 200] for _, b in bodies for p in range(len(b) - 199))
    out = []
    for i, b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    docs = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(80).collect()]
    line = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage = line(260)
    docs += [(1000 + i, line(rng.randint(0, 90)) + passage + line(rng.randint(0, 90))) for i in range(30)]
    docs += [(2000, "a" * 700), (2001, "ab" * 300), (2002, docs[5][1]), (2003, passage[:199]), (2004, passage[3:203]), (2005, None), (2006, ""), (2007, "x" * 199), (None, passage), (2008, passage + "q" + passage), (2009, "tw"), (2009, "tw"), (2010, docs[7][1]), (2010, docs[7][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n_spans int").repartition(4)
    want = slow(docs)
    for classes, most in ((suffixes.CLASSES, suffixes.MOST), (3, suffixes.MOST), (3, 2), (50, 2)):
        got = without_repeats(df, classes, most=most).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert without_repeats(df.limit(0)).collect() == []


def test_suffix_sort():
    rng = np.random.default_rng(4)
    for size in (0, 1, 2, 7, 300):
        body = rng.integers(97, 99, size + 400).astype(np.uint8)
        body[200:300] = 97
        at = rng.integers(0, size + 200, size)
        group = np.sort(rng.integers(0, 4, size))
        length = np.array([200, 210, 399, 200])[group]
        body = np.append(body, np.zeros(400, np.uint8))
        order = suffixes.suffix_sort(suffixes.Hashes(body), body, group, at, length)
        key = lambda i: (group[i], bytes(body[at[i] : at[i] + length[i]]))
        assert order.tolist() == sorted(range(size), key=key)


def test_hashes():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, (1 << 61) - 1, 1000, dtype=np.uint64), rng.integers(0, (1 << 61) - 1, 1000, dtype=np.uint64)
    assert suffixes.times(a, b).tolist() == [x * y % ((1 << 61) - 1) for x, y in zip(a.tolist(), b.tolist())]
    body = rng.integers(0, 256, 500).astype(np.uint8)
    h = suffixes.Hashes(np.concatenate([body, body[100:400]]))
    x = np.arange(100, 300)
    assert h.same(x, x + 400, 100).all() and not h.same(x, x + 401, 99).any() and (h.of(x, 100) == h.of(x + 400, 100)).all()


def test_strings_that_collide_modulo_a_power_of_two(spark):
    """Thue-Morse strings have equal polynomial hashes modulo 2**64 whatever the base; they are no repeats."""
    rng = random.Random(8)
    lead = "".join(rng.choice("abcdefgh é") for _ in range(110))
    for n in (128, 256, 1024, 4096):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        docs = [(1, lead + word[:n]), (2, lead + word[:n].translate(str.maketrans("ab", "ba")))]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        for classes in (suffixes.CLASSES, 0):
            got = without_repeats(df, classes).collect()
            assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == slow(docs)


def test_long_text_in_pieces(spark):
    rng = random.Random(9)
    line = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    x, y = line(900), line(3000)
    docs = [(1, line(2000) + x + line(333) + x + y), (2, y[5:] + line(10)), (3, x), (4, line(699)), (4, y), (4, y)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = without_repeats(df, piece=700).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == slow(docs)


def test_windows_around_a_common_line_are_not_listed_one_by_one(spark, monkeypatch):
    rng = random.Random(10)
    line = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    common, passage = line(100), line(300)
    docs = [(i, line(260) + common + line(260)) for i in range(90)] + [(500 + i, line(150) + passage + line(150)) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows, keep = {}, suffixes.keep

    def counted(table, label):
        kept = keep(table, label)
        rows[label] = kept.count()
        return kept

    monkeypatch.setattr(suffixes, "keep", counted)
    got = without_repeats(df, classes=3).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == slow(docs)
    spans = rows["suffix-spans"]
    assert spans >= 90 and max(n for label, n in rows.items() if label not in ("suffix-classes", "suffix-spans")) <= 3 * spans, rows
