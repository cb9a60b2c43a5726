"""Personal data: fixed patterns, and further spans chosen by boosted trees among candidates of high recall.

Candidate generators propose spans that may overlap (a run of digits may be both a card and a phone number). Boosted
trees score them on format and context; a threshold for each kind, set on held-out candidates, selects. What the
fixed patterns find always stays.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.boosting import Trees, boost, calibrated_threshold
from strandloom.llm.common import slices, table

KINDS = ("email", "ip", "card", "phone")
#: About so many documents are read to gather candidates to fit on, and at most so many candidates.
SAMPLE_DOCS, SAMPLE_CANDIDATES = 20_000, 20_000
PRECISION = 0.98
#: Rewritten forms, and plain pieces, to learn from for each found span.
WAYS = 3
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits fails whenever the run's first digit does, so only first digits are tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of the address pattern, in linear time: from each @ to the left and to the right."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, by start and kind."""
    found = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


#: Dashes and blanks that stand for the plain ones.
DASHES, BLANKS = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "\u00a0\u2002\u2003\u2007\u2009\u200a\u202f"
PLAIN = str.maketrans(DASHES + BLANKS, "-" * len(DASHES) + " " * len(BLANKS))
#: Digits with at most two separators, or a dot in brackets, between them.
NUMBER = re.compile(rf"(?<![0-9A-Za-z@_])[0-9](?:(?:\[\.\]|\(\.\)|[ ()./:{DASHES}{BLANKS}-]{{0,2}})[0-9])*+")
DIGITS = re.compile("[0-9]+")
DOTS = (".", "[.]", "(.)")
EXTENSION = re.compile(r" ?(?:x|ext\.?) ?[0-9]{1,6}(?![0-9A-Za-z])", re.IGNORECASE)
HIDDEN = re.compile(r" ?[\[(]at[\])] ?| at (?=[A-Za-z0-9-]{1,63}(?:\.[A-Za-z]{2,}| (?:\(dot\)|\[dot\]|dot) ))|_at_| ?@ ?", re.IGNORECASE)
HIDDEN_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?| dot |_dot_|\[\.\]|\(\.\)|\.)[A-Za-z0-9-]{1,63}){1,4}", re.IGNORECASE)


def number_spans(text: str, start: int, end: int) -> Iterator[Span]:
    """Runs of a stretch's groups of digits that may be a number of some kind.

    A run has 4 to 19 digits, so few begin at each group. The last group is left out if a letter follows that begins no
    extension; an extension behind it makes one more span.
    """
    parts = [(m.start(), m.end()) for m in DIGITS.finditer(text, start, end)]
    extension = EXTENSION.match(text, end)
    if not extension and (text[end : end + 1].isalnum() or text[end : end + 1] in ("@", "_")):
        parts.pop()
    for i, (first, _) in enumerate(parts):
        a, n = first, 0
        while a > 0 and first - a < 2 and text[a - 1] in "+(":
            a -= 1
        for j in range(i, len(parts)):
            b = parts[j][1]
            n += b - parts[j][0]
            if n > 19:
                break
            if 7 <= n <= 15:
                yield "phone", a, b
                if extension and j == len(parts) - 1:
                    yield "phone", a, extension.end()
            if 12 <= n:
                yield "card", first, b
            if j == i + 3 and n <= 12 and all(text[parts[k][1] : parts[k + 1][0]] in DOTS for k in range(i, j)):
                yield "ip", first, b


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data, of any kind, overlapping."""
    found = []
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            if m.end() - m.start() >= 7:
                found += number_spans(text, m.start(), m.end())
    for m in HIDDEN.finditer(text):
        start = m.start()
        while start > max(0, m.start() - 64) and text[start - 1] in LOCAL:
            start -= 1
        d = HIDDEN_DOMAIN.match(text, m.end())
        if d and start < m.start():
            found.append(("email", start, d.end()))
    return found


class Taken:
    """Intervals without overlap, in order."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [], []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def take(self, a: int, b: int) -> None:
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


CUES = {
    "email": re.compile(r"mail|contact|write|escrib|schreib", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|host|server|addr", re.IGNORECASE),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta", re.IGNORECASE),
    "phone": re.compile(r"phone|call|tel|fax|mobil|cell", re.IGNORECASE),
}
DATE = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}")


def beside(text: str) -> int:
    """What parts a number from digits that go on next to it: 0 no digits, 1 nothing or a blank, 2 a dash or dot, 3 other."""
    at = next((i for i, c in enumerate(text[:3]) if c.isdigit()), None)
    if at is None or not all(c in " ()./:-" for c in text[:at]):
        return 0
    return 1 if not text[:at].strip() else 2 if text[0] in "-." else 3


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its context, 40 characters on either side."""
    kind, a, b = span
    s, before, after = (x.translate(PLAIN) for x in (text[a:b], text[max(0, a - 40) : a], text[b : b + 40]))
    groups = [len(g) for g in NOT_DIGIT.split(s) if g] or [0]
    digits = NOT_DIGIT.sub("", s)
    words_ = re.split(r"[^A-Za-z0-9]+", s)
    tail = words_[-1] if words_ else ""
    return [
        float(KINDS.index(kind)), float(len(digits)), float(b - a), float(len(groups)), float(max(groups)), float(min(groups)),
        float(s[:1] == "+"), float("(" in s), float(s.count(".")), float(s.count("-")), float(s.count(" ")), float(s.count("/") + s.count(":")),
        float(kind == "card" and luhn(digits)), float(digits[:1] or -1), float(bool(DATE.search(s))), float("@" in s),
        float(bool(CUES[kind].search(before))), float(bool(CUES[kind].search(after))), float(sum(c.isdigit() for c in before + after)),
        float(before[-1:].isalpha()), float(2 <= len(tail) <= 6 and tail.isalpha()), float("dot" in s.lower()), float("at)" in s.lower() or "at]" in s.lower()),
        float(beside(before[::-1])), float(beside(after)), float("[.]" in s or "(.)" in s), float("x" in s[-8:]), float("_at_" in s.lower()), float(" @ " in s),
        float(after[:1].isalpha()), float(tail.islower()),
    ]


def rewritten(text: str, span: Span, turn: int) -> tuple[str, Span]:
    """The text with one found span written as people also write it; a span to learn from."""
    kind, a, b = span
    s = text[a:b]
    tail = ""
    if kind == "email":
        if turn // 6 % 2:  # a name needn't have digits
            s = s[0] + DIGITS.sub("", s[1:])
        name, domain = s.rsplit("@", 1)
        at, dot = ((" (at) ", "."), (" at ", " dot "), ("[at]", " (dot) "), ("@", "(dot)"), (" @ ", "."), ("_at_", "_dot_"))[turn % 6]
        s = name + at + domain.replace(".", dot)
    elif kind == "phone":
        groups = [g for g in NOT_DIGIT.split(s) if g]
        own = groups[len(groups) > 3 :]
        s = (re.sub(r"^\+1?[ .-]?", "", s), s.replace("-", ".").lstrip("+"), "-".join(own), " ".join(groups), "\u2013".join(own), "".join(own), "-".join(own) + f"x{10 + turn % 900}", "".join(own))[turn % 8]
        tail = f"/{s[::-1]}" if turn % 16 == 7 else ""
    elif kind == "card":
        d = NOT_DIGIT.sub("", s)
        s = ("-", ".", " ", "\u2013")[turn % 4].join(d[i : i + 4] for i in range(0, len(d), 4))
    else:
        s = s.replace(".", DOTS[1 + turn % 2])
    return text[:a] + s + tail + text[b:], (kind, a, a + len(s))


def plain_pieces(turn: int) -> str:
    """What is nobody's: dates, amounts, times, counters, prices, sentences without a blank between."""
    k = turn * 7919 % 100_003
    return (
        f"{1990 + k % 40}-{1 + k % 12:02d}-{1 + k % 28:02d}", f"{1 + k % 28}.{1 + k % 12}.{1990 + k % 40}", f"{1000000 + k * 97}", f"{k % 24:02d}:{k % 60:02d}:{k % 59:02d} {k % 9}",
        f"{1990 + k % 30} {1991 + k % 30}", f"{k}.{k % 100:02d} {k % 977}", f"{10**11 + k * 1234577}", f"{k % 90 + 10}/{k % 50} {k % 1000}", f"v{k % 9}.{k % 20}.{k % 30}.{k % 7}", f"INV-{10**6 + k * 13}",
        f"{k % 9 + 1} @ {k % 90}.{k % 100:02d}", f"stay at home{'.' * (k % 3 == 0)}.Then go", "look at it.So they did",
    )[turn % 13]


@dataclass
class Finder:
    """A fitted model and the threshold of each kind; without a model only the fixed patterns count."""

    model: Trees | None
    thresholds: tuple[float, ...]

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Base spans and the chosen candidates, which overlap nothing else; the surer one wins."""
        if self.model is None:
            return base
        taken = Taken(base)
        fresh = [c for c in candidates(text) if taken.free(c[1], c[2])]
        if not fresh:
            return base
        p = self.model.probability(np.array([features(text, c) for c in fresh]))
        extra: list[Span] = []
        # Of equally sure ones the longest wins, then the first.
        for i in sorted(range(len(fresh)), key=lambda i: (-p[i], fresh[i][1] - fresh[i][2], fresh[i][1])):
            c = fresh[i]
            if p[i] >= self.thresholds[KINDS.index(c[0])] and taken.free(c[1], c[2]):
                extra.append(c)
                taken.take(c[1], c[2])
        return in_order(base + extra)


def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and marks to learn from, and a hash of the text that they come from: found spans and rewritten forms
    of them (1); parts of those, other candidates, and plain numbers in the same surroundings (0)."""
    for batch in slices(batches, "text", 4 << 20):
        rows, marks, groups = [], [], []

        def add(text: str, span: Span, mark: int, group: int) -> None:
            rows.append(features(text, span))
            marks.append(mark)
            groups.append(group)

        for text in batch.column("text").to_pylist():
            text = text or ""
            base, own = base_spans(text), xxhash.xxh64_intdigest(text.encode(), 8) >> 1
            for turn, span in enumerate(base):
                turn += span[1]
                add(text, span, 1, own)
                # Only the surroundings of the span are written anew.
                low = max(0, span[1] - 200)
                near, here = text[low : span[2] + 200], (span[0], span[1] - low, span[2] - low)
                for way in range(turn, turn + WAYS):
                    other, moved = rewritten(near, here, way)
                    found = candidates(other)
                    if moved in found:
                        add(other, moved, 1, own)
                        for c in found:
                            if c != moved and moved[1] <= c[1] and c[2] <= moved[2]:
                                add(other, c, 0, own)
                    piece = plain_pieces(way)
                    other = near[: here[1]] + piece + near[here[2] :]
                    for c in candidates(other):
                        if here[1] <= c[1] and c[2] <= here[1] + len(piece):
                            add(other, c, 0, own)
            taken = Taken(base)
            for c in candidates(text):
                if taken.free(c[1], c[2]):
                    add(text, c, 0, own)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(marks, pa.int32()), pa.array(groups, pa.int64())], ["x", "y", "g"])


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS, most: int = SAMPLE_CANDIDATES) -> Finder:
    """Fit on candidates of about ``sample`` documents, by a hash of the id; null ids are left out.

    Of the candidates' texts, by their hash, half are for the trees, a quarter sets the probabilities, and a quarter
    the thresholds; copies of a text go the same way.
    """
    share = min(1.0, sample / max(1, docs.count()))
    picked = docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 30)) < int(share * (1 << 30))).filter("text is not null and doc_id is not null")
    rows = picked.select(F.col("text").cast("string").alias("text")).mapInArrow(examples, "x array<double>, y int, g long")
    got = rows.withColumn("h", F.xxhash64("g")).orderBy("h", "g", "y", "x").limit(most).select("x", "y", "g").toArrow()
    if got.num_rows < 40:
        return Finder(None, (1.1,) * len(KINDS))
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(got.num_rows, -1)
    y, turn = np.asarray(got.column("y")), np.asarray(got.column("g")) % 4
    if any(len(np.unique(y[some])) < 2 for some in (turn < 2, turn == 2)):
        return Finder(None, (1.1,) * len(KINDS))
    model = boost(x[turn < 3], y[turn < 3], held=turn[turn < 3] == 2)
    last = turn == 3
    p, kind = model.probability(x[last]), x[last][:, 0].astype(int)
    return Finder(model, tuple(calibrated_threshold(p[kind == k], y[last][kind == k], PRECISION) for k in range(len(KINDS))))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, finder: Finder) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of ``docs``.

    Counts and hash are of the fixed patterns' spans; spans has the chosen candidates too. Null text: as empty. Whole
    texts are read, in time that grows as they do. Each row has its own result. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            counts, hashes, spans = [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                counts.append([sum(s[0] == k for s in base) for k in KINDS])
                hashes.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(finder.spans(text or "", base)))
            n = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(n[:, i]) for i in range(len(KINDS))], pa.array(hashes), pa.array(spans)], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first one in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by [EMAIL], [IP], [CARD] or [PHONE]; n_chars follows the text.

    Null and empty texts stay as they are; long ones are read whole. Rows with equal ids or texts are each rewritten alike.
    No rows: no rows. All other columns are kept, whatever their names.
    """
    finder, schema = fit(docs), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            texts = [redacted(t, finder.spans(t, base_spans(t))) if t is not None else None for t in batch.column("text").to_pylist()]
            place = batch.schema.get_field_index("text")
            batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
            if "n_chars" in batch.schema.names:
                place = batch.schema.get_field_index("n_chars")
                batch = batch.set_column(place, batch.schema.field(place), pa.array([None if t is None else len(t) for t in texts], batch.schema.field(place).type))
            yield batch

    return docs.mapInArrow(run, schema)
