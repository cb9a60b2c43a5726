"""Toxicity as a severity grade, by cumulative-link (proportional-odds) regression.

One weight a feature is shared by all thresholds: P(grade >= k) = sigmoid(score - threshold_k), thresholds ascending.
Features are words and the strings of ``GRAMS`` characters inside them (^ and $ stand for a word's ends), each with
the logarithm of one plus its count in the text. Those are used that mark toxic documents, chosen by chi-square.
The labels only say toxic or not. Grades are made from them: 0 for clean documents; toxic ones get 1, or 2 if their
share of words that hold a feature is above the median of the toxic documents.
A quarter of the labelled documents, dealt by their words so that copies stay together, takes no part in choosing
features or in fitting; the probability from which on a document is rejected is set on it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import keep, slices, table, words

#: At most so many labelled documents are used for fitting (those with the least hashes of their ids), and so many features.
SAMPLE, VOCABULARY, GRADES = 16000, 2048, 3
#: Lengths of the strings inside a word; words of more than ``LONG`` characters have no such strings.
GRAMS, LONG = (4, 5, 6), 64
#: Of the held-out clean documents at most this share may be rejected; each counts as ``DEAR`` toxic ones missed.
MOST_LOST, DEAR = 0.02, 2.0
EDGES = ".,;:!?\"'()[]{}*#%$&|-_…«»“”‘’¡¿"


def plain(flat: pa.Array) -> pa.DictionaryArray:
    """Words without punctuation at either end, in lower case, as a dictionary array."""
    coded = pc.dictionary_encode(flat)
    return pa.DictionaryArray.from_arrays(coded.indices, pc.utf8_lower(pc.utf8_trim(coded.dictionary, EDGES)))


def features_of(word: str) -> set[str]:
    """The word itself, marked by =, and the strings inside it."""
    out = {"=" + word}
    if 0 < len(word) <= LONG:
        marked = f"^{word}$"
        out.update(marked[i : i + k] for k in GRAMS for i in range(len(marked) - k + 1))
    return out if word else set()


class Sparse:
    """A matrix by its entries; only products with vectors."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.value, self.shape = row, col, value, shape

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], minlength=self.shape[0])

    @property
    def T(self) -> Sparse:  # noqa: N802
        return Sparse(self.col, self.row, self.value, self.shape[::-1])


def logs(row: np.ndarray, col: np.ndarray, times: np.ndarray, shape: tuple[int, int]) -> Sparse:
    """Entries log(1 + count), counts of the same place summed up."""
    pair, back = np.unique(row.astype(np.int64) * max(1, shape[1]) + col, return_inverse=True)
    return Sparse(pair // max(1, shape[1]), pair % max(1, shape[1]), np.log1p(np.bincount(back, times, minlength=len(pair))), shape)


@dataclass
class Severity:
    """A fitted model: features, their weights, ascending thresholds between grades, and the least probability of
    grade 1 or more that rejects a document."""

    features: list[str]
    weights: np.ndarray
    thresholds: np.ndarray
    reject: float = 0.5
    known: dict[str, np.ndarray] = field(default_factory=dict)

    def numbers(self, word: str) -> np.ndarray:
        """Numbers of the word's features; remembered for a bounded number of words."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            if not hasattr(self, "place"):
                self.place = {f: i for i, f in enumerate(self.features)}
            got = np.array([self.place[f] for f in features_of(word) if f in self.place], np.int64)
            if len(word) <= LONG:
                self.known[word] = got
        return got

    def counts(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number and feature number of every occurrence; words that hold a feature, and all words, by text."""
        flat, offs = words(col, lower=False)
        if not len(flat):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(col), np.int64), np.diff(offs)
        coded = plain(flat)
        own = [self.numbers(w) for w in coded.dictionary.to_pylist()]
        size = np.array([len(x) for x in own])
        index = np.asarray(coded.indices)
        hit = np.flatnonzero(size[index])
        row, index = np.searchsorted(offs, hit, side="right") - 1, index[hit]
        first = np.cumsum(size) - size
        n = size[index]
        at = np.arange(n.sum()) + np.repeat(first[index] - np.cumsum(n) + n, n)
        return np.repeat(row, n), np.concatenate(own)[at].astype(np.int64), np.bincount(row, minlength=len(col)), np.diff(offs)

    def probabilities(self, col: pa.Array) -> np.ndarray:
        """P(grade >= k) of each text, a column for each k from 1 on."""
        row, number, _, _ = self.counts(col)
        score = logs(row, number, np.ones(len(row)), (len(col), len(self.features))) @ self.weights
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))

    def score(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            above = self.probabilities(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(above[:, 0]), pa.array(above.sum(axis=1)), pa.array((above >= 0.5).sum(axis=1).astype(np.int32)), pa.array(above[:, 0] >= self.reject)],
                ["doc_id", "p_toxic", "expected_severity", "grade", "toxic"],
            )


def fit_ordinal(x, grade: np.ndarray, grades: int = GRADES, l2: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of a proportional-odds model, by accelerated gradient steps.

    ``x`` (rows, features) is ``Sparse`` or a dense array. Thresholds are the first one and positive gaps, so they
    keep their order.
    """
    w, n = np.zeros(x.shape[1]), x.shape[0]
    share = np.clip([(grade >= k).mean() for k in range(1, grades)], 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(-np.log(share / (1 - share)))
    theta = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    m, v = np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))
    rows, turned = np.arange(n), x.T
    for step in range(1, steps + 1):
        cuts = np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])
        s = x @ w
        above = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(cuts[None, :] - s[:, None], -30, 30))), np.zeros((n, 1))], axis=1)
        p = np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-12)
        slope = above * (1 - above)
        d_s = -(slope[rows, grade] - slope[rows, grade + 1]) / p / n
        d_cut = np.zeros((n, grades - 1))
        low, high = grade >= 1, grade <= grades - 2
        d_cut[rows[low], grade[low] - 1] += (slope[rows, grade] / p / n)[low]
        d_cut[rows[high], grade[high]] -= (slope[rows, grade + 1] / p / n)[high]
        total = d_cut.sum(axis=0)
        tail = np.cumsum(total[::-1])[::-1]
        g = np.concatenate([turned @ d_s + l2 * w, [tail[0]], tail[1:] * np.exp(theta[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, theta = w - move[: len(w)], theta - move[len(w) :]
    return w, np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])


def reject_from(score: np.ndarray, toxic: np.ndarray, most_lost: float = MOST_LOST, dear: float = DEAR) -> float:
    """The score from which on to reject: of the places between two neighbouring scores that lose at most
    ``most_lost`` of the clean rows, the one where the share of toxic rows caught less ``dear`` times the share of
    clean ones lost is greatest (of equals the highest)."""
    order = np.argsort(-score, kind="stable")
    s, y = score[order], toxic[order]
    caught, lost = np.cumsum(y) / max(1, y.sum()), np.cumsum(~y) / max(1, (~y).sum())
    worth = np.where((lost <= most_lost) & (np.append(s[:-1] > s[1:], True)), caught - dear * lost, -1.0)
    k = int(np.argmax(worth))
    if worth[k] <= 0:
        return float(s[0]) + 1.0
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def chosen_features(bags: DataFrame, most: int = VOCABULARY) -> list[str]:
    """The features that mark toxic documents most, by chi-square: each in three or more places, thrice as common there.

    ``bags`` holds toxic (0 or 1) and names (distinct words) of each document; what is counted are words of documents.
    Features of a word are made once a distinct word.
    """
    per_word = bags.select("toxic", F.explode("names").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("d"), F.sum("toxic").cast("long").alias("a"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, d, a = [], [], []
            for w, x, y in zip(*(batch.column(c).to_pylist() for c in ("word", "d", "a"))):
                own = sorted(features_of(w))
                names += own
                d += [x] * len(own)
                a += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(d, pa.int64()), pa.array(a, pa.int64())], ["feature", "d", "a"])

    whole = bags.agg(F.sum(F.size("names")).alias("n"), F.sum(F.size("names") * F.col("toxic")).alias("n1")).first()
    n, n1 = float(whole["n"] or 0), float(whole["n1"] or 0)
    if not 0 < n1 < n:
        return []
    d, a = F.col("d"), F.col("a")
    chi = F.lit(n) * F.pow(a * (n - n1 - d + a) - (n1 - a) * (d - a), 2) / (n1 * (n - n1) * d * (n - d))
    rank = per_word.mapInArrow(spread, "feature string, d long, a long").groupBy("feature").agg(F.sum("d").cast("double").alias("d"), F.sum("a").cast("double").alias("a"))
    rank = rank.filter((d >= 3) & (d < n) & (a * (n - n1) > 3 * (d - a) * n1)).withColumn("chi", chi).filter("chi > 10")
    return [r["feature"] for r in rank.orderBy(F.desc("chi"), "feature").limit(most).select("feature").collect()]


def bags_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, toxic, held (0: not used for fitting), distinct words and their counts of each text."""
    for batch in slices(batches, "text", 4 << 20):
        flat, offs = words(batch.column("text"), lower=False)
        coded = plain(flat)
        names, index = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        lists, held = [], []
        for a, b in zip(offs[:-1], offs[1:]):
            bag = sorted(Counter(names[i] for i in index[a:b]))
            lists.append(bag)
            held.append(xxhash.xxh64_intdigest("\n".join(bag), 6) % 4 == 0)
        yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("_toxic"), pa.array(held), pa.array(lists, pa.list_(pa.string())), batch.column("text")], ["id", "toxic", "held", "names", "text"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Severity:
    """Fit on at most ``sample`` labelled documents, those with the least hashes of their ids.

    Labels or ids that are null are left out; of several labels of one id the largest holds, of several rows of one id
    the least text. Null and empty texts have no words. Without any toxic or any clean document in the part to fit
    on, no document is ever toxic; without such in the held-out part the threshold is one half.
    """
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    share = min(1.0, sample / max(1, marks.count()))
    marks = marks.withColumn("_h", F.pmod(F.xxhash64("_id"), F.lit(1 << 30))).filter(F.col("_h") < int(share * (1 << 30))).orderBy("_h", "_id").limit(sample).drop("_h")
    picked = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"))
    picked = picked.join(F.broadcast(marks), F.col("_doc") == F.col("_id"))  # at most ``sample`` ids
    picked = picked.groupBy("_doc").agg(F.max("_toxic").alias("_toxic"), F.min("text").alias("text"))
    bags = picked.mapInArrow(bags_of, "id long, toxic int, held boolean, names array<string>, text string").withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    bags = keep(bags, "toxicity-sample")
    never = Severity([], np.zeros(0), np.array([50.0, 51.0]))
    train = bags.filter("not held")
    if train.select("toxic").distinct().count() < 2:
        return never
    names = chosen_features(train)
    if not names:
        return never
    blank = Severity(names, np.zeros(len(names)), np.zeros(GRADES - 1))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            row, number, telling, total = blank.counts(batch.column("text"))
            pair, times = np.unique(row * len(names) + number, return_counts=True)
            ends = np.searchsorted(pair // len(names), np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pair % len(names), times)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), batch.column("held"), pa.array(telling / np.maximum(total, 1)), *lists], ["id", "toxic", "held", "share", "number", "times"])

    # Numbers only come to the driver: at most ``sample`` rows of at most ``VOCABULARY`` entries.
    got = bags.mapInArrow(entries, "id long, toxic int, held boolean, share double, number array<int>, times array<int>").toArrow().combine_chunks().sort_by("id")
    toxic, held, share_of = (np.asarray(got.column(c)) for c in ("toxic", "held", "share"))
    toxic = toxic > 0
    number, times = (np.asarray(pc.list_flatten(got.column(c)).combine_chunks(), np.int64) for c in ("number", "times"))
    row = np.repeat(np.arange(got.num_rows), np.asarray(pc.list_value_length(got.column("number"))))

    def part(some: np.ndarray) -> Sparse:
        new = np.cumsum(some) - 1
        mine = some[row]
        return logs(new[row[mine]], number[mine], times[mine], (int(some.sum()), len(names)))

    grade = toxic.astype(np.int64) + (toxic & (share_of > np.median(share_of[toxic & ~held])))
    weights, thresholds = fit_ordinal(part(~held), grade[~held])
    model = Severity(names, weights, thresholds)
    if toxic[held].any() and not toxic[held].all():
        at = reject_from(part(held) @ weights, toxic[held])
        model.reject = float(1 / (1 + np.exp(np.clip(thresholds[0] - at, -500, 500))))
    return model


def severity(docs: DataFrame, model: Severity) -> DataFrame:
    """doc_id, p_toxic, expected_severity (0 to 2), grade, toxic of every row of ``docs``.

    Null and empty texts have no words and get the model's lowest severity. Whole texts are read, however long. Each
    row has its own result, so equal rows have equal ones. No rows: no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(model.score, "doc_id long, p_toxic double, expected_severity double, grade int, toxic boolean")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, fit(docs, table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, unchanged, with all their columns. Null and empty texts stay; equal rows stay or
    go together; no rows: no rows."""
    model = fit(docs, table(spark, sf_dir, "labels"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            yield batch.filter(pa.array(model.probabilities(batch.column("text"))[:, 0] < model.reject))

    return docs.mapInArrow(clean, docs.schema)
