"""Scoring texts with an n-gram trie in Elias-Fano form.

The trie has two levels. Level one holds the words, numbered by their place in the ascending sequence of word hashes: an
Elias-Fano sequence of hashes, one of running counts (a word's count is the difference of two), and the quantised weight
that each word as a context leaves to single words. Level two holds each context's successors, as runs of word numbers:
monotone pointers, an Elias-Fano sequence too, say where each context's run begins. Behind a run, numbers go on from its
last one, so that the level ascends as a whole; a search takes the run of its context from the pointers, what stands
before it, and seeks the successor in that run only. Level two keeps quantised smoothed probabilities. Every level lies in
flat files, one for each range of keys, that the scoring tasks map into memory; no process holds the model. A context
with very many successors lies in several files, each with its own part of the run.

Smoothing: interpolated absolute discounting, p(w | h) = max(c(h w) - D, 0) / c(h) + D n(h) / c(h) * u(w) with
u(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) and D = n1 / (n1 + 2 n2) from the pair counts of counts. A text starts in the
context of the end mark; behind an unseen word u(w) holds. A word is followed as often as it stands there (the end mark
by each text's first word), so c(h) is its count in level one. For every context the probabilities of the V known words and
of one unknown word sum to 1, up to the quantisation step of ``STEP``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import keep, shared_path, slices, table, words
from strandloom.llm.eliasfano import files, mapped

#: Log10 probabilities are kept as multiples of this in 16 bits: 0 to -13.1.
STEP = 2e-4
#: Keys that a task gathers before it counts them, and rows of one file of the trie.
GATHER, FILE_ROWS = 2_000_000, 1_000_000
END = np.uint64(xxhash.xxh64_intdigest(b"", 42))


def local(path: str) -> str:
    """The mounted path of a folder in the shared file system."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"the trie needs a shared folder that executors can map files from, not {path}")
    return path


def hashed(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different word hashes, ascending, each token's place among them, flat, with the end mark behind each text, and
    the texts' offsets."""
    flat, offs = words(col)
    d = pc.dictionary_encode(flat)
    h = [xxhash.xxh64_intdigest(w, 42) for w in d.dictionary.cast(pa.binary()).to_pylist()]
    distinct, place = np.unique(np.array([*h, END], np.uint64), return_inverse=True)
    out = np.full(len(flat) + len(offs) - 1, place[-1], np.int64)
    if len(flat):
        out[np.arange(len(flat)) + np.repeat(np.arange(len(offs) - 1), np.diff(offs))] = place[np.asarray(d.indices)]
    return distinct, out, offs + np.arange(len(offs))


def preceding(tokens: np.ndarray, offs: np.ndarray, end: int) -> np.ndarray:
    """What stands before each token; the end mark before a text's first one."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[offs[:-1]] = end
    return before


def emit(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 500_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 500_000].view(np.int64)), pa.array(counts[at : at + 500_000].astype(np.int64))], ["key", "n"])


def counted(pieces: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Sums of the keys' counts, over a bounded number of keys at a time."""

    def summed() -> Iterator[pa.RecordBatch]:
        keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return emit(keys, np.bincount(place, np.concatenate([n for _, n in held])))

    held, size = [], 0
    for keys, counts in pieces:
        held.append((keys, counts))
        size += len(keys)
        if size >= GATHER:
            yield from summed()
            held, size = [], 0
    if size:
        yield from summed()


def ranged(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Sorted by ``key`` in partitions of about ``FILE_ROWS`` rows."""
    return df.repartitionByRange(max(1, -(-rows // FILE_ROWS)), key).sortWithinPartitions(key)


class Level:
    """The files of a level by their ranges of keys, and for words by their numbers too."""

    def __init__(self, rows: list[dict], kind: type):
        self.rows = rows
        self.first, self.last = (np.array([f[x] for f in rows], kind) for x in ("first", "last"))
        self.base = np.cumsum([0] + [f["n"] for f in rows])

    @staticmethod
    def parts(starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[int, slice]]:
        for i in np.flatnonzero(starts < stops):
            yield int(i), slice(int(starts[i]), int(stops[i]))

    def by_key(self, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Files with some of the ascending ``keys`` in their range, and which."""
        return self.parts(np.searchsorted(keys, self.first), np.searchsorted(keys, self.last, side="right"))

    def by_number(self, numbers: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Files that hold some of the ascending ``numbers``, and which."""
        at = np.searchsorted(numbers, self.base)
        return self.parts(at[:-1], at[1:])


class Trie:
    """Where the files of a fitted model lie, and its totals."""

    def __init__(self, folder: str, levels: list[dict], pairs: list[dict], n: int, v: int, discount: float):
        self.folder, self.levels, self.pairs, self.n, self.v, self.discount = folder, levels, pairs, n, v, discount
        self.single, self.double = Level(levels, np.uint64), Level(pairs, np.int64)

    def path(self, row: dict) -> str:
        return os.path.join(self.folder, row["file"])

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.n + 0.5 * (self.v + 1))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each of the ascending hashes, -1 where unseen in training."""
        out = np.full(len(hashes), -1, np.int64)
        for i, some in self.single.by_key(hashes):
            row = self.levels[i]
            at = mapped(self.path(row) + ".hash", row["n"]).find(hashes[some] - np.uint64(row["first"]))
            out[some] = np.where(at >= 0, at + self.single.base[i], -1)
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """How often the words of these ascending numbers stand in training (-1: never)."""
        out = np.zeros(len(numbers), np.int64)
        for i, some in self.single.by_number(numbers):
            at = numbers[some] - self.single.base[i]
            upto = mapped(self.path(self.levels[i]) + ".count", self.levels[i]["n"] + 1)
            out[some] = (upto.get(at + 1) - upto.get(at)).astype(np.int64)
        return out

    def backoffs(self, contexts: np.ndarray) -> np.ndarray:
        """Log10 weight that each of the ascending contexts leaves to single words."""
        out = np.zeros(len(contexts))
        for i, some in self.single.by_number(contexts):
            out[some] = coded(self.path(self.levels[i]) + ".backoff")[contexts[some] - self.single.base[i]] * -STEP
        return out

    def pair_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Smoothed log10 probability of each of the ascending pair keys, NaN where the pair is unseen."""
        out = np.full(len(keys), np.nan)
        for i, some in self.double.by_key(keys):
            row, (context, word) = self.pairs[i], np.divmod(keys[some], self.v)
            contexts, which = np.unique(context - row["first"] // self.v, return_inverse=True)
            pointers, seq = mapped(self.path(row) + ".start", row["contexts"] + 1), mapped(self.path(row), row["n"])
            start, stop = (pointers.get(contexts + x).astype(np.int64) for x in (0, 1))
            before = np.where(start > 0, seq.get(np.maximum(start - 1, 0)).astype(np.int64) + 1, 0)
            at = seq.find(before[which] + word, start[which], stop[which])
            out[some] = np.where(at >= 0, coded(self.path(row) + ".code")[np.maximum(at, 0)] * -STEP, np.nan)
        return out

    def score(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = self.numbers(np.array([END]))[0]
        for batch in slices(batches, "text", 4 << 20):
            distinct, tokens, offs = hashed(batch.column("text"))
            number, count = self.numbers(distinct), np.zeros(len(distinct), np.int64)
            known = np.flatnonzero(number >= 0)
            count[known] = self.counts(number[known])
            base, count, number = np.log10(self.unigram(count))[tokens], count[tokens], number[tokens]
            before = preceding(number, offs, end)
            seen = np.flatnonzero((before >= 0) & (number >= 0))
            pairs, where = np.unique(before[seen] * max(1, self.v) + number[seen], return_inverse=True)
            pair = np.full(len(tokens), np.nan)
            pair[seen] = self.pair_probabilities(pairs)[where]
            logp = np.where(np.isnan(pair), base, pair)
            left = np.flatnonzero((before >= 0) & np.isnan(pair))
            contexts, where = np.unique(before[left], return_inverse=True)
            logp[left] += self.backoffs(contexts)[where]
            total = lambda x: np.add.reduceat(x, offs[:-1])  # noqa: E731  every text has an end mark
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(offs)), pa.array(total((count > 0).astype(np.int64))), pa.array(np.full(batch.num_rows, self.n)), pa.array(total(base)), pa.array(total(logp))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )


@lru_cache(maxsize=4096)
def coded(path: str) -> np.ndarray:
    return np.memmap(path, np.uint16, "r")


def save_sequence(folder: str, name: str, values: np.ndarray) -> None:
    for ending, array in files(values).items():
        save(folder, f"{name}.{ending}", array)


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Written aside and moved, so that a repeated task leaves the same whole file."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    aside = f"{path}.{os.getpid()}.{TaskContext.get().taskAttemptId()}"
    array.tofile(aside)
    os.replace(aside, path)


def code(log10p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-log10p / STEP), 65535).astype(np.uint16)


def with_split(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, text. Held out: crc32 of the id as text leaves 1 when divided by 5; a null id counts as ''."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame) -> Trie:
    """Count the words and pairs of all training documents and write the trie's files to the shared folder."""
    spark = docs.sparkSession
    folder = local(shared_path(spark, "trie"))
    train = with_split(docs).filter(~F.col("held_out")).select("text")

    def word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for b in slices(batches, "text", 4 << 20):
                distinct, tokens, _ = hashed(b.column("text"))
                n = np.bincount(tokens, minlength=len(distinct))
                yield distinct[n > 0], n[n > 0]

        return counted(pieces())

    # As a signed key the order is that of the hash with its first bit flipped.
    single = keep(train.mapInArrow(word_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "trie-words")
    totals = single.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).first()
    v, n = totals["v"], totals["n"] or 0
    if not v:
        return Trie(folder, [], [], 0, 0, 0.5)

    def word_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column("key")), np.asarray(b.column("n"))) for b in batches]
        if parts:
            keys, counts = (np.concatenate(x) for x in zip(*parts))
            keys = keys.view(np.uint64)
            order = np.argsort(keys, kind="stable")  # a partition may hold both signs
            name = f"words-{TaskContext.get().partitionId():05d}"
            save_sequence(folder, f"{name}.hash", keys[order] - keys.min())
            save_sequence(folder, f"{name}.count", np.concatenate([[0], np.cumsum(counts[order])]))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([str(keys.min())]), pa.array([str(keys.max())]), pa.array([len(keys)])], ["file", "first", "last", "n"])

    hashed_order = ranged(single.withColumn("place", F.shiftrightunsigned("key", 1)), "place", v).drop("place")
    levels = [r.asDict() | {"first": int(r["first"]), "last": int(r["last"])} for r in hashed_order.mapInArrow(word_files, "file string, first string, last string, n long").collect()]  # one row a file
    levels.sort(key=lambda f: f["first"])
    half = Trie(folder, levels, [], n, v, 0.5)

    def pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            end = half.numbers(np.array([END]))[0]
            for b in slices(batches, "text", 4 << 20):
                distinct, tokens, offs = hashed(b.column("text"))
                number = half.numbers(distinct)[tokens]
                yield preceding(number, offs, end) * v + number, np.ones(len(number))

        return counted(keys())

    pairs = keep(train.mapInArrow(pair_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "trie-pairs")
    ones = pairs.agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2")).first()
    discount = min(0.95, max(0.05, ones["n1"] / max(1, ones["n1"] + 2 * ones["n2"])))
    # Every word of a training text is a context (of the end mark at least), so the numbers have no holes.
    contexts = pairs.groupBy(F.expr(f"key div {v}").alias("key")).agg(F.count(F.lit(1)).alias("kinds"))
    bases = [int(b) for b in half.single.base[:-1]]
    owner = F.size(F.filter(F.array(*[F.lit(b) for b in bases]), lambda b: b <= F.col("key")))

    def backoff_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.asarray(b.column("key")), np.asarray(b.column("kinds"))) for b in batches]
        if held:
            keys, kinds = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys)
            keys, kinds = keys[order], kinds[order]
            weight = np.log10(discount * kinds / half.counts(keys))
            for i, some in half.single.by_number(keys):
                out = np.zeros(levels[i]["n"], np.uint16)
                out[keys[some] - bases[i]] = code(weight[some])
                save(folder, f"{levels[i]['file']}.backoff", out)
        yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], ["done"])

    contexts.repartition(len(bases), owner).mapInArrow(backoff_files, "done long").count()

    def pair_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(np.asarray(b.column(i)) for i in range(2)) for b in batches]
        if parts:
            keys, counts = (np.concatenate(x) for x in zip(*parts))
            name = f"pairs-{TaskContext.get().partitionId():05d}"
            context, word = np.divmod(keys, v)
            words_, at = np.unique(word, return_inverse=True)
            unigram = half.unigram(half.counts(words_))[at]
            own = np.arange(context[0], context[-1] + 1)
            start = np.searchsorted(context, np.append(own, own[-1] + 1))
            # What this file's contexts leave to single words is read as stored, however many files share the first and last.
            n = np.diff(start)
            p = np.maximum(counts - discount, 0) / np.repeat(half.counts(own), n) + np.repeat(10 ** half.backoffs(own), n) * unigram
            ends = np.where(n > 0, word[np.maximum(start[1:] - 1, 0)] + 1, 0)
            save_sequence(folder, name, word + np.repeat(np.cumsum(ends) - ends, n))
            save_sequence(folder, f"{name}.start", start)
            save(folder, f"{name}.code", code(np.log10(p)))
            row = [name, int(keys[0]), int(keys[-1]), len(keys), len(own)]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["file", "first", "last", "n", "contexts"])

    rows = ranged(pairs, "key", ones["rows"]).mapInArrow(pair_files, "file string, first long, last long, n long, contexts long").collect()  # one row a file
    return Trie(folder, levels, sorted((r.asDict() for r in rows), key=lambda f: f["first"]), n, v, discount)


def scores(docs: DataFrame, trie: Trie) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Null and empty texts consist of the end mark. Whole texts are scored, however long. Each row has its own score, so
    repeated rows have equal ones, and they count as often as they stand there in training. No rows: no rows. Other
    columns are ignored.
    """
    return with_split(docs).mapInArrow(trie.score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, fit(docs))
