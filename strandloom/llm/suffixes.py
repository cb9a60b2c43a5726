"""Removal of repeated byte strings by a hash-compared suffix sort.

Suffixes are compared by prefix polynomial hashes modulo the prime 2**61 - 1: a binary search finds how far two of
them agree, and the byte behind decides. Only suffixes that can be equal for ``LENGTH`` bytes are ever compared: each
window of that length is named by its minimizer, the ``GRAM``-byte string in it whose hash is least. Neighbouring
windows with the same minimizer form a run. Runs with the same text are one class, told by a 128-bit cryptographic
digest; a class of several runs is repeated as a whole, and one run stands for it from there on. Where a minimizer has
several classes, the windows of the runs that stand for them go through a mergesort of suffixes, and neighbours in the
sorted order that agree in ``LENGTH`` bytes are repeated. Each such pair is verified byte by byte.

A minimizer with more than ``CLASSES`` classes is dealt out before it is sorted, so that no group grows with the data:
its windows are counted under two independent hashes modulo the prime, as many neighbours at once as ``WIDTHS`` says in
turn, and two of each kind that is met again go through the same sort, a group for each kind. Neighbours whose
common bytes (their core) are met nowhere else hold no repeated window and are cut no further. That is exact: equal
windows have equal hashes, and unequal windows under one pair of hashes, which the sort would show, raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import keep, slices, table, text_bytes

LENGTH, GRAM = 200, 64
#: Classes of one minimizer that are sorted in one group.
CLASSES = 64
#: Runs of one minimizer that are held at once.
MOST = 200_000
#: Bytes of spans that one sort works on, besides the group at hand; bytes of a text that are hashed at once.
BLOCK, PIECE = 1 << 20, 2 << 20
#: Neighbouring windows that are counted together where a minimizer has more classes than that; from one to the next, only
#: those are cut that can still hold a window that is met again.
WIDTHS = (64, 8, 1)
PLACE = 28  # bits for a place in a piece of text
PRIME = np.uint64((1 << 61) - 1)
LOW32, LOW29 = np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1)


def folded(x: np.ndarray) -> np.ndarray:
    """``x`` modulo 2**61 - 1."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return x - PRIME * (x >= PRIME)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1 of numbers below it; the 128-bit product is put together from halves."""
    ah, al, bh, bl = a >> np.uint64(32), a & LOW32, b >> np.uint64(32), b & LOW32
    low, mid, high = al * bl, ah * bl + al * bh, ah * bh
    return folded((high << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & LOW29) << np.uint64(32)) + (low & PRIME) + (low >> np.uint64(61)))


class Hashes:
    """Prefix hashes of a byte array modulo 2**61 - 1; any two places' strings are compared in constant time."""

    def __init__(self, body: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        base, n = np.uint64(rng.integers(1 << 60, (1 << 61) - 1)), len(body)
        values = rng.integers(1, (1 << 61) - 1, 256, dtype=np.uint64)
        self.power = np.ones(n + 1, np.uint64)
        done, step = 1, base
        while done <= n:  # twice as many powers in each pass
            more = min(done, n + 1 - done)
            self.power[done : done + more] = times(self.power[:more], step)
            step, done = times(step, step), done + more
        terms = times(values[body], self.power[:n])
        self.sums = np.zeros(n + 1, np.uint64)
        high, low = np.cumsum(terms >> np.uint64(30), dtype=np.uint64), np.cumsum(terms & np.uint64((1 << 30) - 1), dtype=np.uint64)
        self.sums[1:] = folded(times(folded(high), np.uint64(1 << 30)) + folded(low))

    def span(self, start: np.ndarray, size) -> np.ndarray:
        return folded(self.sums[start + size] + PRIME - self.sums[start])

    def same(self, x: np.ndarray, y: np.ndarray, size) -> np.ndarray:
        """Whether the strings of ``size`` bytes from each ``x`` and ``y`` have the same hash."""
        left, right = np.minimum(x, y), np.maximum(x, y)
        return times(self.span(left, size), self.power[right - left]) == self.span(right, size)

    def of(self, start: np.ndarray, size) -> np.ndarray:
        """Hash of ``size`` bytes from each of ``start``, the same wherever the string stands, in this or another body."""
        if not len(start):
            return np.zeros(0, np.uint64)
        if not hasattr(self, "back"):
            inverse = pow(int(self.power[1]), -1, int(PRIME))
            self.back, done, step = np.ones(len(self.power), np.uint64), 1, np.uint64(inverse)
            while done < len(self.back):
                more = min(done, len(self.back) - done)
                self.back[done : done + more] = times(self.back[:more], step)
                step, done = times(step, step), done + more
        return times(self.span(start, size), self.back[start])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(body: np.ndarray) -> np.ndarray:
    """A hash of each ``GRAM``-byte string, modulo 2**64. It only deals windows into groups: equal strings have equal
    ones, and unequal strings under one hash merely share a group."""
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62, 1 << 63)) * 2 + 1
    values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(body)
    step, back = np.full(n, base, np.uint64), np.full(n - GRAM + 1, pow(base, -1, 1 << 64), np.uint64)
    step[0] = back[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[body] * np.cumprod(step, dtype=np.uint64), out=sums[1:], dtype=np.uint64)
    return mixed((sums[GRAM:] - sums[:-GRAM]) * np.cumprod(back, dtype=np.uint64))


def minimizers(grams: np.ndarray) -> np.ndarray:
    """For each window start, the place of its least string (the leftmost of equals)."""
    width = LENGTH - GRAM + 1
    least = (grams >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """Bytes of texts back to back, their offsets, and row, place in its text, doc and th of each.

    A long text comes in pieces that overlap by ``LENGTH`` - 1 bytes, so each window lies in one of them.
    """
    for batch in slices(batches, "text", piece):
        body, offs = text_bytes(batch.column("text"))
        doc, th = batch.column("doc"), batch.column("th")
        for at in range(0, max(1, len(body) - LENGTH + 1), piece) if batch.num_rows == 1 else [0]:
            part = body[at : at + piece + LENGTH - 1] if batch.num_rows == 1 else body
            if len(part) >= LENGTH:
                yield part, np.array([0, len(part)]) if batch.num_rows == 1 else offs, np.arange(batch.num_rows), np.full(batch.num_rows, at), doc, th


def runs(batches: Iterator[pa.RecordBatch], piece: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Runs of windows with one minimizer: its hash v, the run's digest s, s2, its document and place.

    Runs that are met again in the piece at hand are listed at once (m = -1, under a random v, so that no task gets all
    copies of a text); one row stands for all m of them. Other runs have m = 0.
    """
    for body, offs, rows, base, doc, th in pieces(batches, piece):
        n = len(body)
        grams = gram_hashes(body)
        place = minimizers(grams)
        owner = np.repeat(rows, np.diff(offs))
        start = np.flatnonzero(owner[: n - LENGTH + 1] == owner[LENGTH - 1 :])
        if not len(start):
            continue
        at = place[start]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
        v = grams[at[first]].view(np.int64)
        count = np.diff(np.concatenate([first, [len(start)]]))
        p0, a = start[first], at[first]
        view, digest = memoryview(body), hashlib.blake2b
        s = np.frombuffer(b"".join([digest(view[x:y], digest_size=16).digest() for x, y in zip(p0.tolist(), (p0 + LENGTH - 1 + count).tolist())]), np.int64)
        mine = owner[p0]
        packed = (p0 - offs[mine] + base[mine]) << 16 | count << 8 | (a - p0)  # number of windows and place of the minimizer: under 256
        _, one, kind, n_kind = np.unique(s.view("V16"), return_index=True, return_inverse=True, return_counts=True)
        again = np.flatnonzero(n_kind[kind] > 1)
        some = np.concatenate([np.flatnonzero(n_kind[kind] == 1), one[n_kind > 1], again])
        m = np.concatenate([np.zeros(len(some) - len(again), np.int32), np.full(len(again), -1, np.int32)])
        m[(n_kind == 1).sum() : len(m) - len(again)] = n_kind[n_kind > 1]
        v = np.where(m < 0, mixed((packed[some] ^ (np.arange(len(some)) << 40)).astype(np.uint64)).view(np.int64), v[some])
        mine = pa.array(mine[some])
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(s[::2][some]), pa.array(s[1::2][some]), doc.take(mine), th.take(mine), pa.array(packed[some].astype(np.int64)), pa.array(m)], ["v", "s", "s2", "doc", "th", "place", "m"])


RUN = "v long, s long, s2 long, doc long, th long, place long, m int"
P, COUNT, ANCHOR = "shiftright(place, 16)", "(shiftright(place, 8) & 255)", "(place & 255)"
CLASS = "v long, doc long, th long, place long, copy boolean, large boolean"


def classified(batches: Iterator[pa.RecordBatch], classes: int, most: int) -> Iterator[pa.RecordBatch]:
    """What a partition of runs that is sorted by v, s, s2 says of them: rows with copy = true for all runs of a class of
    several; rows with copy = false, one a class, of minimizers with several classes, ``large`` if they are over ``classes``.

    Runs go by in order. Of a minimizer with over ``most`` runs only one run a class is held, and of one with very
    many classes only the last.
    """
    names = ["v", "s", "s2", "doc", "th", "place"]

    def first_of(cols: dict, keys: list[str]) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], np.any([cols[k][1:] != cols[k][:-1] for k in keys], axis=0)]))

    def rows(cols: dict, some: np.ndarray, copy: bool, large) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(cols[c][some]) for c in ("v", "doc", "th", "place")], pa.array(np.full(len(some), copy)), pa.array(np.broadcast_to(large, len(some)))], [c.split()[0] for c in CLASS.split(", ")])

    def judged(cols: dict) -> Iterator[pa.RecordBatch]:
        """Whole minimizers. Columns besides the runs': m (0: a run; more: that many runs that are listed as copies already),
        r (the class is listed already) and big (the minimizer has more classes than are here)."""
        first = first_of(cols, names[:3])
        size = np.diff(np.append(first, len(cols["v"])))
        total = np.add.reduceat(np.maximum(cols["m"], 1), first)
        yield rows(cols, np.flatnonzero(np.repeat(total > 1, size) & (cols["m"] == 0)), True, False)
        v = cols["v"][first]
        turn = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        kinds = np.diff(np.append(turn, len(v)))
        big = np.repeat((kinds > classes) | np.maximum.reduceat(cols["big"][first], turn), kinds)
        listed = np.flatnonzero((big | (np.repeat(kinds, kinds) > 1)) & ~cols["r"][first])
        yield rows(cols, first[listed], False, big[listed])

    held: dict = {}
    for batch in batches:
        new = {c: np.asarray(batch.column(i)) for i, c in enumerate([*names, "m"])}
        yield rows(new, np.flatnonzero(new["m"] < 0), True, False)
        some = np.flatnonzero(new["m"] >= 0)
        n = len(some)
        if not n:
            continue
        new = {c: x[some] for c, x in new.items()} | {"m": new["m"][some].astype(np.int64), "r": np.zeros(n, bool), "big": np.zeros(n, bool)}
        held = {c: np.concatenate([held[c], new[c]]) for c in new} if held else new
        last = np.flatnonzero(held["v"][1:] != held["v"][:-1])
        if len(last):
            cut = last[-1] + 1
            yield from judged({c: x[:cut] for c, x in held.items()})
            held = {c: x[cut:] for c, x in held.items()}
        if len(held["v"]) > most:  # one minimizer
            first = first_of(held, names[:3])
            size = np.diff(np.append(first, len(held["v"])))
            total = np.add.reduceat(np.maximum(held["m"], 1), first)
            yield rows(held, np.flatnonzero(np.repeat(total > 1, size) & (held["m"] == 0)), True, False)
            held["m"][first] = np.where(total > 1, total, 0)
            held = {c: x[first] for c, x in held.items()}
            if held["big"].any() or len(first) > classes:
                yield rows(held, np.flatnonzero(~held["r"]), False, True)
                held["r"][:], held["big"][:] = True, True
                held = {c: x[-1:] for c, x in held.items()}
    if held:
        yield from judged(held)


def agree(h: Hashes, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the longest common extension of each two places, up to ``size``, by binary search."""
    out = size.copy()
    some = np.flatnonzero(~h.same(x, y, size))
    x, y, low, high = x[some], y[some], np.zeros(len(some), np.int64), size[some] - 1
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = h.same(x, y, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    out[some] = low
    return out


def suffix_sort(h: Hashes, body: np.ndarray, group: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Order of the suffixes at ``at`` by (group, next ``length`` bytes); stable. ``group`` ascends, and ``length`` is
    the same throughout a group.

    Bottom-up mergesort. In each pass every suffix finds its rank in the neighbouring sorted piece of its group by
    binary search, all at once.
    """
    n = len(at)
    order = np.arange(n)
    first = np.searchsorted(group, group, side="left")
    size = np.searchsorted(group, group, side="right") - first
    width = 1
    while n and width < size.max():
        slot = np.arange(n)
        local = slot - first
        piece = local // width
        other = first + (piece ^ 1) * width
        stop = np.minimum(other + width, first + size)
        left, right = np.minimum(other, stop), stop.copy()
        mine = at[order]
        while (some := np.flatnonzero(left < right)).size:
            mid = (left[some] + right[some]) // 2
            x, y = mine[some], at[order[mid]]
            common = agree(h, x, y, length[some])
            end = common >= length[some]
            bx, by = body[np.minimum(x + common, len(body) - 1)], body[np.minimum(y + common, len(body) - 1)]
            # Equal suffixes keep their order: those of the second piece come after those of the first.
            after = np.where(end, piece[some] % 2 == 1, by < bx)
            left[some] = np.where(after, mid + 1, left[some])
            right[some] = np.where(after, right[some], mid)
        rank = left - np.minimum(other, stop)
        target = first + (piece // 2) * 2 * width + local % width + rank
        new = np.empty_like(order)
        new[target] = order
        order, width = new, width * 2
    return order


def repeated(body: np.ndarray, group: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the suffixes share their next ``length`` bytes (``LENGTH`` to twice that) with another one of their group."""
    h = Hashes(body)
    order = suffix_sort(h, body, group, at, length)
    x, y, size = at[order[:-1]], at[order[1:]], length[order[:-1]]
    pair = np.flatnonzero((group[order[:-1]] == group[order[1:]]))
    pair = pair[h.same(x[pair], y[pair], size[pair])]
    out = np.zeros(len(at), bool)
    view = np.lib.stride_tricks.sliding_window_view(body, LENGTH)
    for k in range(0, len(pair), 20_000):  # byte by byte, against collisions of hashes: the first and the last window
        p = pair[k : k + 20_000]
        last = size[p] - LENGTH
        p = p[(view[x[p]] == view[y[p]]).all(axis=1) & (view[x[p] + last] == view[y[p] + last]).all(axis=1)]
        out[order[p]] = out[order[p + 1]] = True
    return out


SPAN = "v long, w long, doc long, th long, p long, count int, anchor int, whole boolean, must boolean, span binary"


def sorted_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals doc, th, a, b that repeated windows cover, from a partition of spans that is sorted by v, w.

    ``whole``: the spans of this v, w have one text, or should, and are compared as one suffix each, not by windows.
    ``must``: another span with the same text is known to be there; if the sort doesn't find it, a digest collided.
    """

    def block(cols: list) -> Iterator[pa.RecordBatch]:
        v, w, doc, th, p, count, anchor, whole, must, span = cols
        sizes = np.array([len(x) for x in span])
        base = np.cumsum(sizes) - sizes
        body = np.frombuffer(b"".join(span), np.uint8)
        each = np.where(whole, 1, count)
        row = np.repeat(np.arange(len(v)), each)
        k = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        # Windows can be equal only if the minimizer stands at the same place in both.
        order = np.lexsort((k, anchor[row] - k, w[row], v[row]))
        row, k = row[order], k[order]
        off = anchor[row] - k
        group = np.cumsum(np.concatenate([[0], (v[row][1:] != v[row][:-1]) | (w[row][1:] != w[row][:-1]) | (off[1:] != off[:-1])]))
        many = np.flatnonzero(np.bincount(group)[group] > 1)
        row, k, group = row[many], k[many], group[many]
        hit = repeated(body, group, base[row] + k, LENGTH - 1 + np.where(whole[row], count[row], 1)) if len(row) else np.zeros(0, bool)
        row, k = row[hit], k[hit]
        if (np.bincount(row, minlength=len(v)) < each)[must].any():
            raise ValueError("two different texts have the same digest")
        if not len(row):
            return
        order = np.lexsort((k, row))
        row, k = row[order], k[order]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (k[1:] != k[:-1] + 1)]))
        last = np.concatenate([first[1:], [len(row)]]) - 1
        r = row[first]
        end = np.where(whole[r], count[r] - 1, k[last])
        yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(th[r]), pa.array((p[r] + k[first]).astype(np.int64)), pa.array((p[r] + end + LENGTH).astype(np.int64))], ["doc", "th", "a", "b"])

    held: list = []
    for batch in slices(batches, "span", BLOCK):
        cols = [np.asarray(batch.column(i)) for i in range(9)] + [batch.column(9).to_pylist()]
        held = [np.concatenate(x) for x in zip(held[:9], cols[:9])] + [held[9] + cols[9]] if held else cols
        change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
        if len(change):  # the last group may go on
            cut = change[-1] + 1
            yield from block([x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held:
        yield from block(held)


def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each of a document's runs."""
    names = ["v", "w", "p", "count", "anchor", "whole", "must", "large"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_()]
    for batch in slices(batches, "text", PIECE):
        for doc, th, text, todo in zip(*[batch.column(c).to_pylist() for c in ("doc", "th", "text", "todo")]):
            body = text.encode()
            for at in range(0, len(todo), 4096):
                some = todo[at : at + 4096]
                cols = [pa.array([r[n] for r in some], k) for n, k in zip(names, kinds)]
                spans = pa.array([body[r["p"] : r["p"] + r["count"] - 1 + LENGTH] for r in some], pa.binary())
                yield pa.RecordBatch.from_arrays([*cols, pa.array([doc] * len(some), pa.int64()), pa.array([th] * len(some), pa.int64()), spans], [*names, "doc", "th", "span"])


def with_text(docs: DataFrame, todo: DataFrame) -> DataFrame:
    """The rows of ``todo`` (doc, th, and what ``cut_spans`` needs) with their spans' texts. Equal rows of ``docs`` are one."""
    by_doc = todo.groupBy("doc", "th").agg(F.collect_list(F.struct("v", "w", "p", "count", "anchor", "whole", "must", "large")).alias("todo"))
    texts = docs.select("doc", "th", "text").join(by_doc, ["doc", "th"]).groupBy("doc", "th").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    return texts.mapInArrow(cut_spans, "v long, w long, p long, count int, anchor int, whole boolean, must boolean, large boolean, doc long, th long, span binary")


def in_sorted_groups(spans: DataFrame) -> DataFrame:
    """Intervals doc, th, a, b of the repeated windows of spans, each v, w a group of its own."""
    rows = spans.selectExpr(*[c.split()[0] for c in SPAN.split(", ")]).repartition("v", "w").sortWithinPartitions("v", "w")
    return rows.mapInArrow(sorted_spans, "doc long, th long, a long, b long")


NODE = "b1 long, b2 long, count int, slot int, c1 long, c2 long, anchor int, doc long, th long, a long, span binary"


def node_hashes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The windows of spans whose minimizer has very many classes, up to ``width`` neighbours a row.

    Rows are cut where a window's minimizer stands at a multiple of ``width`` (``slot`` counts them). Two hashes of the
    row's text (b1, b2), and two of its core (c1, c2): the bytes that every window of its slot would have around the
    minimizer. Equal windows lie in rows with equal cores, whatever else these rows hold.
    """
    for batch in slices(batches, "span", BLOCK):
        spans = batch.column("span").to_pylist()
        if not spans:
            continue
        sizes = np.array([len(x) for x in spans])
        count = np.asarray(batch.column("count")).astype(np.int64)
        body = np.frombuffer(b"".join(spans), np.uint8)
        row = np.repeat(np.arange(len(spans)), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        off = np.asarray(batch.column("anchor")).astype(np.int64)[row] - k
        slot = off // width
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (slot[1:] != slot[:-1])]))
        c = np.diff(np.append(first, len(row)))
        row, k, off, slot = row[first], k[first], off[first], slot[first]
        at = (np.cumsum(sizes) - sizes)[row] + k
        least, most = slot * width, np.minimum(slot * width + width - 1, LENGTH - GRAM)
        whole, core = (at, LENGTH - 1 + c), (at + off - least, LENGTH - (most - least))
        one, other = Hashes(body, 1), Hashes(body, 2)
        keys = [pa.array(h.of(*x).view(np.int64)) for x in (whole, core) for h in (one, other)]
        texts = [spans[r][x : x + n] for r, x, n in zip(row.tolist(), k.tolist(), (LENGTH - 1 + c).tolist())]
        mine = [pa.array(np.asarray(batch.column(x))[row]) for x in ("doc", "th")]
        place = np.asarray(batch.column("p"))[row].astype(np.int64) + k
        cols = [*keys[:2], pa.array(c.astype(np.int32)), pa.array(slot.astype(np.int32)), *keys[2:], pa.array(off.astype(np.int32)), *mine, pa.array(place), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in NODE.split(", ")])


def two_of_each(rows: DataFrame, keys: list[str], also: list[str]) -> DataFrame:
    """keys, n, low, high: the number of rows of each kind, and the first and the last of them in order of doc, th, ``also``."""
    one = F.struct("doc", "th", *also)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("low"), F.max(one).alias("high"))


def standing(kinds: DataFrame) -> DataFrame:
    """The rows that stand for each kind, one or two; ``must``: it is one of two different ones."""
    two = F.col("low") != F.col("high")
    rest = [c for c in kinds.columns if c not in ("low", "high", "n")]
    return kinds.select(*rest, two.alias("must"), F.explode(F.when(two, F.array("low", "high")).otherwise(F.array("low"))).alias("one")).select(*rest, "must", "one.*")


def dealt_windows(docs: DataFrame, spans: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Intervals doc, th, a, b that repeated windows of the large spans cover.

    Rows of neighbouring windows with equal texts are copies of each other, and one of each kind stands for them. It is
    cut further only if a row of another kind has its core: in all others no window is left that could be met again.
    """
    rows, found, todo = spans, [], []
    kind = ["b1", "b2", "count", "slot", "c1", "c2", "anchor"]
    for width in widths:
        rows = keep(rows.mapInArrow(lambda b, w=width: node_hashes(b, w), NODE), f"suffix-rows-{width}")
        kinds = keep(two_of_each(rows, kind, ["a"]), f"suffix-kinds-{width}")
        many = kinds.filter("n > 1")
        found.append(rows.join(many.select("b1", "b2", "count"), ["b1", "b2", "count"], "left_semi").select("doc", "th", "a", F.expr(f"a + count - 1 + {LENGTH}").alias("b")))
        # Two of each kind that is met again are sorted and compared byte by byte.
        todo.append(standing(many).select("doc", "th", F.col("b1").alias("v"), F.col("b2").alias("w"), F.col("a").alias("p"), "count", "must"))
        core = ["slot", "c1", "c2"]
        shared = kinds.groupBy(*core).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*core)
        further = kinds.join(shared, core, "left_semi").select("low.doc", "low.th", "low.a", "count")
        rows = rows.join(further, ["doc", "th", "a", "count"], "left_semi").select("doc", "th", F.col("a").alias("p"), "count", "anchor", "span")
    copies, again = reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, todo)
    again = again.select("*", F.lit(0).alias("anchor"), F.lit(True).alias("whole"), F.lit(False).alias("large"))
    return copies.unionByName(in_sorted_groups(with_text(docs, again)))


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4 << 20):
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            body = (text or "").encode()
            merged: list[list[int]] = []
            for s in ((x >> 16, (x >> 16) + (x & 65535)) for x in sorted(spans or ())):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            kept, at = [], 0
            for a, b in merged:
                kept.append(body[at:a])
                at = b
            kept.append(body[at:])
            rows.append((len(body), sum(b - a for a, b in merged), len(merged), hashlib.sha256(b"".join(kept)).hexdigest(), b"".join(kept)))
        n, gone, count, digest, left = zip(*rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(digest), pa.array(left, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_intervals(docs: DataFrame, classes: int = CLASSES, piece: int = PIECE, most: int = MOST) -> DataFrame:
    """doc, th, ab: byte intervals of documents (doc, th: id and text hash) that repeated windows cover, both ends in one number."""
    found = docs.select("doc", "th", "text").mapInArrow(lambda b: runs(b, piece), RUN).repartition("v").sortWithinPartitions("v", "s", "s2")
    kinds = keep(found.mapInArrow(lambda b: classified(b, classes, most), CLASS), "suffix-classes")
    copies = kinds.filter("copy").select("doc", "th", F.expr(P).alias("a"), F.expr(f"{P} + {COUNT} - 1 + {LENGTH}").alias("b"))
    todo = kinds.filter("not copy").select(
        "doc", "th", "v", F.lit(0).cast("long").alias("w"), F.expr(P).alias("p"), F.expr(f"cast({COUNT} as int)").alias("count"), F.expr(f"cast({ANCHOR} as int)").alias("anchor"),
        F.lit(False).alias("whole"), F.lit(False).alias("must"), "large",
    )
    spans = keep(with_text(docs, todo), "suffix-spans")
    intervals = copies.unionByName(in_sorted_groups(spans.filter("not large")))
    large = spans.filter("large")
    if not large.isEmpty():
        intervals = intervals.unionByName(dealt_windows(docs, large))
    return intervals.select("doc", "th", F.expr("shiftleft(a, 16) + b - a").alias("ab"))  # an interval is shorter than 512 bytes


def without_repeats(docs: DataFrame, classes: int = CLASSES, piece: int = PIECE, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left) of every row of ``docs``.

    A byte goes if a string of ``LENGTH`` bytes over it also starts at another place, in any document. Null texts are
    empty; shorter texts stay whole. Repeated rows are copies of each other and go. Texts of any length are read in
    pieces. No rows: no rows. Other columns are ignored. Rows that share an id (null ids are one) are told apart by a
    64-bit hash of their texts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("doc", F.coalesce(F.col("doc_id"), F.lit(-1).cast("long"))).withColumn("th", F.xxhash64("text"))
    spans = repeated_intervals(docs, classes, piece, most).groupBy("doc", "th").agg(F.collect_set("ab").alias("spans"))
    out = docs.join(spans, ["doc", "th"], "left").select("doc_id", "text", "spans")
    return out.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")
