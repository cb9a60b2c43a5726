"""Spelling variants: words that differ by one edit, found by dense tiles of padded code-point matrices.

Two words, the longer of length m, differ by one inserted, deleted or replaced code point exactly if their common prefix
and their common suffix together reach m - 1 (and they aren't equal). The edit then stands at place
min(prefix, m - 1) of the longer one. The places are cut into a left and a right half: if the edit stands in one half,
all that lies outside of it is equal in both words. So words are dealt by class m and what lies outside a half: a
word of length m is a long one in class m and a short one in class m + 1. Within such a bucket blocks of words are
compared with blocks as matrices, each pair in the half where its edit stands and nowhere else. A bucket of many
words is cut again, at halves of the half, until the edit's place is one code point; then what is left is bounded by
the alphabet. Pairs are counted where they are found and never leave the tile.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import keep, slices, table

#: What a run is, after A-Z have become small; one deletion in so many runs; what a word needs.
RUN = re.compile("[a-zÀ-ÿ]+")
EVERY, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
#: Words of one block, and bytes of text of two blocks at most (one word may be longer).
BLOCK, TILE_BYTES = 256, 1 << 22
#: Words of a bucket that are compared as they are; a larger one is cut again.
LARGE = 1024
#: Different words whose counts one task holds before it gives them out.
HELD = 500_000


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n: runs of each text (doc_id as text, text), with one code point deleted where the hash says so."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = [w for w in held if len(w) >= LEAST_LENGTH]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

    for batch in slices(batches, "text", 8 << 20):
        for key, text in zip(batch.column(0).to_pylist(), pc.ascii_lower(batch.column(1)).to_pylist()):
            start = zlib.crc32(f"{key}:".encode())
            for run, n in Counter(RUN.findall(text or "")).items():
                h = zlib.crc32(run.encode(), start)
                if h % EVERY == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]  # noqa: PLW2901
                held[run] += n
            if len(held) > HELD:
                yield out()
                held.clear()
    yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts that are long and frequent enough. Counts are summed up within tasks first."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def halves(low: int, high: int) -> list[tuple[int, int]]:
    middle = (low + high) // 2
    return [(a, b) for a, b in ((low, middle), (middle, high)) if a < b]


def outside(word: bytes, m: int, low: int, high: int) -> bytes:
    """What a word of class ``m`` has outside of the places ``low`` to ``high`` of the longer word: its front and its end."""
    return word[:low] + word[len(word) - (m - high) :] if high < m else word[:low]


BUCKETS = "m int, low int, high int, key binary, word binary, n long"


def as_buckets(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["m", "low", "high", "key", "word", "n"])


def bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of each word (word, n) in its class and the next one."""
    for batch in slices(batches, "word", 4 << 20):
        raw = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
        yield as_buckets([(m, a, b, outside(w, m, a, b), w, n) for w, n in zip(raw, batch.column(1).to_pylist()) for m in (len(w), len(w) + 1) for a, b in halves(0, m)])


def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets dealt anew, by halves of their places."""
    for batch in slices(batches, "word", 4 << 20):
        rows = zip(*(batch.column(c).to_pylist() for c in ("m", "low", "high", "word", "n")))
        yield as_buckets([(m, a, b, outside(w, m, a, b), w, n) for m, low, high, w, n in rows for a, b in halves(low, high)])


class Best:
    """For words, by their place: how many near words they have, and the most frequent one, of equals the least."""

    def __init__(self) -> None:
        self.count: dict[bytes, int] = {}
        self.top: dict[bytes, tuple[int, bytes]] = {}

    def add(self, words: list[bytes], other: list[bytes], n: np.ndarray, near: np.ndarray) -> None:
        """``near`` (word, other): pairs found; ``n`` counts the others, whose order is by falling n, then rising word."""
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            w, row = words[i], near[i]
            first = int(row.argmax())
            self.count[w] = self.count.get(w, 0) + int(row.sum())
            found = (-int(n[first]), other[first])
            if w not in self.top or found < self.top[w]:
                self.top[w] = found

    def rows(self) -> pa.RecordBatch:
        words = list(self.count)
        top = [self.top[w] for w in words]
        cols = [pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([self.count[w] for w in words], pa.int64()), pa.array([-t[0] for t in top], pa.int64()), pa.array([t[1].decode("latin-1") for t in top], pa.string())]
        self.count, self.top = {}, {}
        return pa.RecordBatch.from_arrays(cols, ["word", "n_near", "near_n", "near"])


def matrix(words: list[bytes], m: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words of length m or m - 1, padded at the end and at the front (0 is no code point of a word)."""
    left = np.frombuffer(b"".join(w.ljust(m, b"\0") for w in words), np.uint8).reshape(len(words), m)
    right = np.frombuffer(b"".join(w.rjust(m, b"\0") for w in words), np.uint8).reshape(len(words), m)
    return left, right


def common(a: np.ndarray, b: np.ndarray, columns: range) -> np.ndarray:
    """For each pair of rows the number of ``columns`` that agree before the first that doesn't."""
    alive = np.ones((len(a), len(b)), bool)
    size = np.zeros((len(a), len(b)), np.int32)
    for c in columns:
        alive &= a[:, c, None] == b[None, :, c]
        if not alive.any():
            break
        size += alive
    return size


def tile(m: int, low: int, high: int, a: list[tuple[bytes, int]], b: list[tuple[bytes, int]], best: Best) -> None:
    """Finds near pairs of class ``m`` with the edit at places ``low`` to ``high`` between the words of two blocks.

    Blocks may hold words of several buckets: a pair of different ones has too short a prefix or suffix.
    """
    one, two = [w for w, _ in a], [w for w, _ in b]
    (l1, r1), (l2, r2) = matrix(one, m), matrix(two, m)
    prefix, suffix = common(l1, l2, range(m)), common(r1, r2, range(m - 1, -1, -1))
    # Padding equals padding: two short words aren't a pair of this class, nor is a word with itself.
    long1, long2 = np.array([len(w) == m for w in one]), np.array([len(w) == m for w in two])
    at = np.minimum(prefix, m - 1)
    near = (prefix + suffix >= m - 1) & (prefix < m) & (at >= low) & (at < high) & (long1[:, None] | long2[None, :])
    if near.any():
        n1, n2 = np.array([n for _, n in a]), np.array([n for _, n in b])
        best.add(one, two, n2, near)
        if a is not b:
            best.add(two, one, n1, near.T)


def block_rows(m: int) -> int:
    return max(1, min(BLOCK, TILE_BYTES // (2 * m)))


def compare(m: int, low: int, high: int, buckets: list[list[tuple[bytes, int]]], best: Best) -> None:
    """All near pairs within each of the ``buckets`` with the edit at places ``low`` to ``high``.

    Small buckets share a block; of larger ones all pairs of blocks are compared; a large one is cut at halves of its
    places, if it has more than one.
    """
    order = lambda x: (-x[1], x[0])
    size, held = block_rows(m), []
    for bucket in buckets:
        if len(bucket) > LARGE and high - low > 1:
            for a, b in halves(low, high):
                finer: dict[bytes, list[tuple[bytes, int]]] = {}
                for w, n in bucket:
                    finer.setdefault(outside(w, m, a, b), []).append((w, n))
                compare(m, a, b, [x for x in finer.values() if len(x) > 1], best)
        elif len(bucket) > size:
            blocks = [sorted(bucket[i : i + size], key=order) for i in range(0, len(bucket), size)]
            for i, x in enumerate(blocks):
                for y in blocks[i:]:
                    tile(m, low, high, x, y, best)
        else:
            if len(held) + len(bucket) > size:
                held.sort(key=order)
                tile(m, low, high, held, held, best)
                held = []
            held += bucket
    if held:
        held.sort(key=order)
        tile(m, low, high, held, held, best)


def near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n_near, near_n, near from the buckets (m, low, high, key, word, n) of a partition that is sorted by bucket."""
    best, held, now, last = Best(), [], None, None

    def flush() -> None:
        compare(*now, [b for b in held if len(b) > 1], best)
        held.clear()

    rows = 0
    for batch in batches:
        for m, low, high, key, word, n in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if (m, low, high) != now or (key != last and rows >= 4096):
                if now is not None:
                    flush()
                now, last, rows = (m, low, high), None, 0
                if len(best.count) > HELD // 10:
                    yield best.rows()
            if key != last:
                held.append([])
                last = key
            held[-1].append((word, n))
            rows += 1
    if now is not None:
        flush()
    yield best.rows()


def split_heavy(rows: DataFrame) -> DataFrame:
    """The buckets ``rows`` (m, low, high, key, word, n) with those that hold over a thousandth of all rows, and more than a
    task compares as they are, cut at halves again and again; these are fewer than a thousand and are broadcast."""
    bucket = ["m", "low", "high", "key"]
    done = None
    while True:
        count = keep(rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("count")), "spelling-buckets")
        total = count.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
        heavy = F.broadcast(count.filter((F.col("count") * 1000 > total) & (F.col("count") > LARGE) & (F.col("high") - F.col("low") > 1)).select(*bucket))
        if heavy.isEmpty():
            return rows if done is None else done.unionByName(rows)
        rest = rows.join(heavy, bucket, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        rows = keep(rows.join(heavy, bucket).select("m", "low", "high", "key", "word", "n").mapInArrow(cut_rows, BUCKETS), "spelling-cut")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for the words that have a form (word, form): forms followed to the last, twice as far each round.

    A form is at least twice as frequent as its word, so there are no circles and few rounds.
    """
    now = keep(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = keep(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if now.filter("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least 5 code points that occurs at least 3 times.

    ``docs``: doc_id, text; other columns are ignored. Words are runs of letters (A-Z made small, and U+00C0 to U+00FF
    as they are), some with one code point deleted (by the hash of id and run). Null and empty texts have none; a
    null id counts as an empty one; rows that share an id count each; runs and texts may be of any length. ``form`` is
    the near word of the greatest n (of equals the least in code-point order) if that is at least 2 n, ``root`` the
    last that forms lead to, or the word. No rows: no rows.
    """
    words = keep(word_counts(docs), "spelling-words")
    rows = split_heavy(keep(words.mapInArrow(bucket_rows, BUCKETS), "spelling-rows"))
    parts = rows.repartition("m", "low", "high", "key").sortWithinPartitions("m", "low", "high", "key")
    found = parts.mapInArrow(near_words, "word string, n_near long, near_n long, near string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("top"))
    out = words.join(best, "word", "left").withColumn("has", -F.col("top.m") >= 2 * F.col("n"))
    out = keep(out.select("word", F.when(F.col("has"), F.col("top.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), -F.col("top.m")).alias("form_n")), "spelling-near")
    last = roots(out.filter("form is not null"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
