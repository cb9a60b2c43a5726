"""The alignment of reads with windows of a reference: the small part of mapping that is done in tasks, batch by batch.

Scores: +2 for equal, -2 for different bases, -(k + 1) for a gap of k up to ``max_gap``. The read is used up to its
end; the reference may be entered and left anywhere. A cell in which nothing reaches 0 holds -1 and ends the trace
behind its own base. Ties: diagonal, deletion, insertion; the shorter gap. Of the ends within ``tolerance`` of the
best score the one with the fewest errors counts, then with the fewest indels, then the best-scoring, then the first.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from strandloom.config import DEFAULT, AlignConfig


@dataclass
class Mapping:
    position: int
    mismatches: dict[int, str] = field(default_factory=dict)
    indels: list[tuple[str, int, int]] = field(default_factory=list)

    def errors(self) -> int:
        return len(self.mismatches) + sum(n for _, _, n in self.indels)

    def adjust(self) -> int:
        return sum(n if t == "D" else -n for t, _, n in self.indels)

    def add(self, kind: str, position: int, length: int) -> None:
        """At a position with an indel already, lengths of one type add up and another type is ignored."""
        for i, (t, p, n) in enumerate(self.indels):
            if p == position:
                if t == kind:
                    self.indels[i] = (t, p, n + length)
                return
        self.indels.append((kind, position, length))

    def row(self) -> dict:
        return {
            "position": self.position,
            "mismatches": [{"position": p, "new_base": b} for p, b in sorted(self.mismatches.items())],
            "indels": [{"type": t, "position": p, "length": n} for t, p, n in sorted(self.indels, key=lambda x: x[1])],
        }


@dataclass(frozen=True)
class Window:
    """A part of the reference from ``start`` on; ``length`` is the whole reference's."""

    text: str
    start: int
    length: int

    def base(self, i: int) -> str:
        return self.text[i - self.start] if 0 <= i - self.start < len(self.text) else "\0"


#: Back pointers of one batch of windows hold about so many bytes.
BATCH = 32 << 20
#: Bits of a key that hold a row or column.
PLACE_BITS = 20
PLACES = 1 << PLACE_BITS


def pointers(max_gap: int) -> np.dtype:
    """The type of a back pointer, which goes up to ``max_gap`` + 1."""
    return np.dtype(np.int8 if max_gap < 127 else np.int16 if max_gap < (1 << 15) - 1 else np.int32)


def letters(text: str) -> np.ndarray:
    """A text's code points, one number each."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


@dataclass(frozen=True)
class Task:
    """One alignment: ``read`` on places ``left`` to ``right`` of a reference, both included."""

    ref: Window
    read: str
    left: int
    right: int

    @property
    def rows(self) -> int:
        return self.right - self.left + 1

    def bases(self) -> np.ndarray:
        """The window's letters; places past either end of the text hold 0, which equals no base."""
        text = self.ref.text
        a, b = self.left - self.ref.start, self.right + 1 - self.ref.start
        out = np.zeros(max(b - a, 0), np.uint32)
        inner = letters(text[max(a, 0) : max(b, 0)])
        out[max(-a, 0) : max(-a, 0) + len(inner)] = inner
        return out


class Recent:
    """The greatest of the last ``most`` keys, kept up with a few steps a key: spans of doubling length."""

    def __init__(self, most: int):
        self.levels = most.bit_length() - 1
        self.rest = most - (1 << self.levels)
        self.held: list[list[np.ndarray]] = [[] for _ in range(self.levels + 1)]

    def add(self, key: np.ndarray) -> None:
        for k, held in enumerate(self.held):
            held.append(key)
            back = 1 << k if k < self.levels else self.rest
            if k < self.levels and len(held) > back:
                key = np.maximum(key, held[-1 - back])
            del held[: -1 - back]

    def best(self) -> np.ndarray:
        top = self.held[-1]
        return np.maximum(top[-1], top[-1 - self.rest]) if len(top) > self.rest else top[-1]


def behind(key: np.ndarray, most: int) -> np.ndarray:
    """For each column the greatest key among the ``most`` columns before it (none: a very small number)."""
    out = np.full_like(key, -(1 << 40))
    most = min(most, key.shape[1])
    out[:, 1:] = key[:, :-1]
    span = 1
    while 2 * span <= most:  # twice as many columns in each pass
        out[:, span:] = np.maximum(out[:, span:], out[:, :-span])
        span *= 2
    if span < most:
        out[:, most - span :] = np.maximum(out[:, most - span :], out[:, : out.shape[1] - (most - span)])
    return out


def score_rows(refs: np.ndarray, reads: np.ndarray, max_gap: int, trace: bool, first: int = 0, held: list[np.ndarray] | None = None, stop: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(row, its scores, with ``trace`` its back pointers) of the rows behind ``first``, up to ``stop``, of a batch of windows.

    ``refs`` (window, row) and ``reads`` (window, column) are letters. All windows go on by one row at a time. A back
    pointer is 0 for the origin, 1 for the diagonal, k + 1 for a deletion and -k for an insertion of k. A key holds a
    score and, below it, the place it comes from, so that of equal scores the nearest place is the greatest. ``held``
    are the scores of up to ``max_gap`` rows that end with ``first``: all that the rows behind it depend on.
    """
    count, m = reads.shape
    columns, wide = np.arange(m + 1, dtype=np.int64), np.int64(PLACES)
    above = Recent(max_gap)  # keys of the rows before: (score + row) and the row
    for k, line in enumerate(held or [np.zeros((count, m + 1), np.int64)]):
        row = first - len(held or [0]) + 1 + k
        line = line.astype(np.int64)  # noqa: PLW2901
        above.add((line + row) * wide + row)
    for i in range(first + 1, (refs.shape[1] if stop is None else stop) + 1):
        match = np.full((count, m + 1), -1, np.int64)
        match[:, 1:] = line[:, :-1] + np.where(reads == refs[:, i - 1 : i], 2, -2)
        best = above.best()
        gone, skip = (best >> PLACE_BITS) - i - 1, i - (best & (wide - 1))
        score = np.maximum(match, gone)
        score[:, 0] = 0
        line = np.where(score < 0, -1, score)
        if max_gap == 1:  # a run of insertions loses 2 a column, and none falls below 0 before its end does
            run = np.maximum.accumulate(line + 2 * columns, axis=1) - 2 * columns
            line = np.maximum(line, np.where(run < 0, -1, run))
        while True:  # insertions may follow insertions, as max_gap bounds each
            ahead = behind((line + columns) * wide + columns, max_gap)
            more = (ahead >> PLACE_BITS) - columns - 1
            raised = np.maximum(line, np.where(more < 0, -1, more))
            if not (raised > line).any():
                break
            line = raised
        code = None
        if trace:
            code = np.where(line == match, 1, np.where(line == gone, skip + 1, (ahead & (wide - 1)) - columns))
            code[line < 0] = 0
            code[:, 0] = 0
        yield i, line, code
        above.add((line + i) * wide + i)


def scored(refs: np.ndarray, reads: np.ndarray, max_gap: int, trace: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Last column's scores (window, row), and with ``trace`` back pointers (row, window, column) of a batch of windows.

    ValueError if a window or read is longer than a key can tell.
    """
    (count, n), m = refs.shape, reads.shape[1]
    if max(n, m) + 1 >= PLACES:
        raise ValueError(f"a window or read of over {PLACES - 2} letters")
    back = np.zeros((n + 1, count, m + 1), pointers(max_gap)) if trace else None
    last = np.zeros((count, n + 1), np.int32)
    for i, line, code in score_rows(refs, reads, max_gap, trace):
        last[:, i] = line[:, m]
        if trace:
            back[i] = code
    return last, back


class Checkpoints:
    """Back pointers of one long window, by row and column, without a table of all of them.

    One pass keeps the scores of ``max_gap`` rows at every ``step``-th row. A trace goes upwards, and the rows
    between two of these are scored again, with pointers, when it gets there: both take about the square root of the
    rows.
    """

    def __init__(self, refs: np.ndarray, reads: np.ndarray, max_gap: int):
        self.refs, self.reads, self.max_gap = refs, reads, max_gap
        self.rows, self.step = refs.shape[1], max(1, math.isqrt(refs.shape[1] * max_gap))
        recent = deque([np.zeros((1, reads.shape[1] + 1), np.int32)], maxlen=max_gap)
        self.held, self.at, self.table = {0: list(recent)}, -1, np.zeros((0, 0))
        for i, line, _ in score_rows(refs, reads, max_gap, trace=False):
            recent.append(line.astype(np.int32))
            if i % self.step == 0:
                self.held[i] = list(recent)

    def __getitem__(self, place: tuple[int, int]) -> int:
        i, j = place
        block = (i - 1) // self.step * self.step
        if block != self.at:
            stop = min(block + self.step, self.rows)
            kind = pointers(self.max_gap)
            self.table = np.stack([code[0].astype(kind) for _, _, code in score_rows(self.refs, self.reads, self.max_gap, True, block, self.held[block], stop)])
            self.at = block
        return self.table[i - 1 - block, j]


def traced(refs: np.ndarray, reads: np.ndarray, back: np.ndarray, window: np.ndarray, end: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Errors and number of indels of the traces from row ``end`` of each ``window``'s last column, all at once.

    Steps that meet an indel at the same place add to it, if it is of the same type, or are not counted. ``cut`` rows
    of the task's own window stand before the first row of each window.
    """
    i, j = end.copy(), np.full(len(end), reads.shape[1])
    errors, indels, front = np.zeros(len(end), np.int64), np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
    place, kind = np.full(len(end), -1), np.zeros(len(end), np.int8)  # of the last indel: row, 1 deletion, 2 insertion
    go = np.flatnonzero((i > 0) & (j > 0))
    while len(go):
        w, y, x = window[go], i[go], j[go]
        step = back[y, w, x].astype(np.int64)
        front[go] = x
        row = np.where(step > 1, y - step + 1, np.where(step == 1, y - 1, np.where(step < 0, y, 0)))
        column = np.where(step > 1, x, np.where(step == 1, x - 1, np.where(step < 0, x + step, 0)))
        # A pointer to the origin uses up its own base like a diagonal one; but as a step it may stay in its row or column.
        gap = np.where(column == x, 1, np.where(row == y, 2, 0))
        size = np.where(gap == 1, y - row, x - column)
        at = np.where(gap == 1, row, y)
        same = (gap > 0) & (place[go] == at)
        new = (gap > 0) & ~same
        errors[go] += np.where(new | (same & (kind[go] == gap)), size, 0) + ((gap == 0) & (refs[w, y - 1] != reads[w, x - 1]))
        indels[go] += new
        place[go], kind[go] = np.where(new, at, place[go]), np.where(new, gap, kind[go])
        i[go], j[go] = row, column
        go = go[(row > 0) & (column > 0)]
    rest = front > 1  # what the trace left of the read's front stands at the window's first place
    met = rest & (place + cut[window] == 0)
    errors += np.where(rest & (~met | (kind == 2)), front - 1, 0)
    indels += rest & ~met
    return errors, indels


def mapping_from(task: Task, back: np.ndarray | Checkpoints, end: int, first: int) -> Mapping:
    """The mapping of one trace; ``back`` is one window's (row, column), ``first`` the place where a rest of the read's front is put."""
    out, (i, j), seen, read = Mapping(0), (end, len(task.read)), (0, 0), task.read
    while i > 0 and j > 0:
        seen, step = (i, j), int(back[i, j])
        row, column = (i - step + 1, j) if step > 1 else (i - 1, j - 1) if step == 1 else (i, j + step) if step < 0 else (0, 0)
        if column == j:
            out.add("D", task.left + row, i - row)
        elif row == i:
            out.add("I", task.left + i, j - column)
        elif task.ref.base(task.left + i - 1) != read[j - 1]:
            out.mismatches.setdefault(task.left + i - 1, read[j - 1])
        i, j = row, column
    if seen[1] > 1:
        out.add("I", first, seen[1] - 1)
    out.position = task.left + seen[0] - 1
    return out


def hopeless(last: np.ndarray, m: int, tolerance: int) -> np.ndarray:
    """Which windows are answered by row 0, the read left out in full, which counts as free of errors.

    It is among the ends where the best score is within the tolerance. Any other end free of errors has all of the read
    equal and scores 2 m, so if that is more than the tolerance, there is none, and nothing needs to be traced.
    """
    return (last.max(axis=1) <= tolerance) & (2 * m > tolerance)


def best_ends(last: np.ndarray, tolerance: int, none: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window, row, and whether the score is below the best, of all ends whose score is near the window's best, but for
    the windows in ``none``."""
    top = last.max(axis=1)
    window, end = np.nonzero((last >= top[:, None] - tolerance) & ~none[:, None])
    return window, end, last[window, end] < top[window]


def align_batch(tasks: list[Task], max_gap: int, tolerance: int) -> list[Mapping]:
    """The best mappings of tasks whose windows have one size and whose reads have one length.

    Long windows go through the score table once without back pointers; then each end has a short window of its own,
    which holds all that its trace can reach: a trace over more than 3 rows a base would fall below 0, and so would
    what its cells come from. A window whose table would be larger than a batch goes by checkpoints.
    """
    n, m = tasks[0].rows, len(tasks[0].read)
    both = lambda ts: (np.stack([t.bases() for t in ts]), np.stack([letters(t.read) for t in ts]))
    refs, reads = both(tasks)
    span = 6 * m + 2 * max_gap + 2
    bytes_of = lambda rows: (rows + 1) * (m + 1) * pointers(max_gap).itemsize
    best: dict[int, tuple[tuple, Mapping]] = {}

    def offer(some: np.ndarray, errors: np.ndarray, indels: np.ndarray, made) -> None:
        """Of the ends ``some`` the first of each task stays if it is the best so far; ``made`` gives the mapping of one."""
        # Of equal ones: the best-scoring ends first, then in order of rows.
        order = np.lexsort((end[some], lower[some], indels, errors, owner[some]))
        for x in order[np.unique(owner[some][order], return_index=True)[1]].tolist():
            f = int(some[x])
            k, key = int(owner[f]), (int(errors[x]), int(indels[x]), bool(lower[f]), int(end[f]))
            if k not in best or key < best[k][0]:
                best[k] = (key, made(x))

    if n <= 2 * span and bytes_of(n) <= BATCH:
        last, back = scored(refs, reads, max_gap)
        none = hopeless(last, m, tolerance)
        owner, end, lower = best_ends(last, tolerance, none)
        errors, indels = traced(refs, reads, back, owner, end, np.zeros(len(tasks), np.int64))
        offer(np.arange(len(owner)), errors, indels, lambda x: mapping_from(tasks[owner[x]], back[:, owner[x]], int(end[x]), tasks[owner[x]].left))
    else:
        last, _ = scored(refs, reads, max_gap, trace=False)
        none = hopeless(last, m, tolerance)
        owner, end, lower = best_ends(last, tolerance, none)
        size = np.minimum(end, span)
        many = max(1, BATCH // bytes_of(span))

        def window(f: int) -> Task:
            t, e, rows = tasks[owner[f]], int(end[f]), int(size[f])
            return Task(t.ref, t.read, t.left + e - rows, t.left + e - 1)

        for rows in np.unique(size).tolist():
            mine = np.flatnonzero(size == rows)
            if bytes_of(rows) > BATCH:  # no table, one end at a time
                for f in mine.tolist():
                    short = window(f)
                    got = mapping_from(short, Checkpoints(*both([short]), max_gap), rows, tasks[owner[f]].left)
                    offer(np.array([f]), np.array([got.errors()]), np.array([len(got.indels)]), lambda _, got=got: got)
                continue
            for at in range(0, len(mine), many):
                some = mine[at : at + many]
                shorts = [window(f) for f in some.tolist()]
                r, q = both(shorts)
                back = scored(r, q, max_gap)[1]
                errors, indels = traced(r, q, back, np.arange(len(some)), np.full(len(some), rows), end[some] - rows)
                offer(some, errors, indels, lambda x, some=some, shorts=shorts, back=back, rows=rows: mapping_from(shorts[x], back[:, x], rows, tasks[owner[some[x]]].left))
    return [Mapping(t.left - 1) if none[k] else best[k][1] for k, t in enumerate(tasks)]


#: Letters of a read's pieces; windows of one call; a window is narrowed if less than this share of its rows is left.
PIECE, TOGETHER, NARROWED = 8, 1024, 0.7


def narrowed(task: Task) -> Task | None:
    """The part of a task's window in which all good ends lie, if it is one short part; see ``align_narrow``."""
    m, n = len(task.read), task.rows
    pieces, at = m // PIECE, task.left - task.ref.start
    if pieces < 2 or at < 0 or n < m:
        return None
    text, low, high = task.ref.text[at : at + n], n, 0
    for k in range(pieces):
        piece = task.read[k * PIECE : (k + 1) * PIECE if k < pieces - 1 else m]
        found = text.find(piece)
        if found >= 0:
            low, high = min(low, found - k * PIECE), max(high, text.rfind(piece) - k * PIECE)
    low, high = max(0, low - 5 * pieces), min(n, high + m + 2 * pieces)
    return Task(task.ref, task.read, task.left + low, task.left + high - 1) if 0 < high - low < NARROWED * n else None


def align_narrow(tasks: list[Task], shorts: list[Task], max_gap: int, tolerance: int) -> list[Mapping | None]:
    """What ``align_batch`` gives for tasks of which a part of the window is enough; None where that can't be told.

    Every substitution costs 4 of the greatest score 2 m, a gap 2 or more and 2 for each piece of the read that it
    breaks, so an alignment without any whole piece of p scores 2 (m - p) at most. If the best score less the tolerance
    is above that, all ends that count have a whole piece, and less than 2 p bases deleted: they lie in the part, with
    all that their traces and what ties with them can reach. What begins in the part's first row, where the read's front
    is left out free of charge, scores so much only up to row m + 2 p, in front of which no such end lies.
    """
    m, refs, reads = len(tasks[0].read), np.stack([t.bases() for t in shorts]), np.stack([letters(t.read) for t in shorts])
    pieces, cut = m // PIECE, np.array([s.left - t.left for s, t in zip(shorts, tasks)])
    last, back = scored(refs, reads, max_gap)
    last = np.where((cut[:, None] == 0) | (np.arange(last.shape[1]) > m + 2 * pieces), last, -1)
    top = last.max(axis=1)
    sure = top - tolerance > 2 * (m - pieces)
    owner, end, lower = best_ends(last, tolerance, ~sure)
    errors, indels = traced(refs, reads, back, owner, end, cut)
    order = np.lexsort((end, lower, indels, errors, owner))
    out: list[Mapping | None] = [None] * len(tasks)
    for f in order[np.unique(owner[order], return_index=True)[1]].tolist():
        k = int(owner[f])
        out[k] = mapping_from(shorts[k], back[:, k], int(end[f]), tasks[k].left)
    return out


def align_many(tasks: list[Task], max_gap: int, tolerance: int = 4) -> list[Mapping | None]:
    """The best mapping of each task's read on its window; None for an empty window (of size -1).

    Windows of one size go through the score table together. ValueError for a window that ends before that.
    """
    out: list[Mapping | None] = [None] * len(tasks)
    sizes: dict[tuple[int, int], list[int]] = {}
    parts: dict[tuple[int, int], list[tuple[int, Task]]] = {}
    for k, t in enumerate(tasks):
        if t.rows < -1:
            raise ValueError("a window of negative size")
        if max(t.rows, len(t.read)) + 1 < PLACES and (short := narrowed(t)) is not None:
            parts.setdefault((short.rows, len(t.read)), []).append((k, short))
    for (n, m), where in parts.items():
        many = max(1, min(TOGETHER, BATCH // ((n + 1) * (m + 1) * pointers(max_gap).itemsize)))
        for at in range(0, len(where), many):
            some = where[at : at + many]
            if (n + 1) * (m + 1) * pointers(max_gap).itemsize > BATCH:
                break  # such a table isn't made
            for (k, _), mapping in zip(some, align_narrow([tasks[k] for k, _ in some], [x for _, x in some], max_gap, tolerance)):
                out[k] = mapping
    for k, t in enumerate(tasks):
        if t.rows >= 0 and out[k] is None:
            sizes.setdefault((t.rows, len(t.read)), []).append(k)
    for (n, m), where in sizes.items():
        many = max(1, BATCH // ((min(n, 16 * m) + 1) * (m + 1) * pointers(max_gap).itemsize))
        for at in range(0, len(where), many):
            some = where[at : at + many]
            for k, mapping in zip(some, align_batch([tasks[k] for k in some], max_gap, tolerance)):
                out[k] = mapping
    return out


def align(ref: Window, read: str, left: int, right: int, max_gap: int, tolerance: int = 4) -> Mapping | None:
    """The best mapping of ``read`` on places ``left`` to ``right`` (both included); None for an empty window."""
    return align_many([Task(ref, read, left, right)], max_gap, tolerance)[0]


@dataclass
class Chain:
    """A chain to place: tiles in order and the place of each (-1: not found)."""

    ref: Window
    read: str
    places: list[int]
    tiles: list[str]

    def segments(self, mean: int) -> list[tuple[int, Mapping | Task]]:
        """(number of its tile, mapping of a found tile or task for another one); of a chain of one tile it comes twice."""
        k, out = len(self.places), []
        for turn, i in enumerate([0, *range(1, k - 1), k - 1]):
            if self.places[i] >= 0:
                out.append((i, Mapping(self.places[i])))
                continue
            if turn == 0:
                window = (max(0, self.places[1] - mean - len(self.tiles[0])), self.places[1])
            elif i == k - 1:
                start = self.places[i - 1] + len(self.tiles[i - 1])
                window = (start, min(self.ref.length, start + mean))
            else:
                window = (self.places[i - 1] + len(self.tiles[i - 1]), self.places[i + 1])
            out.append((i, Task(self.ref, self.tiles[i], *window)))
        return out

    def straight(self) -> bool:
        """Whether all tiles, two or more, are found one right behind the other: then ``joined`` gives the first one's place."""
        if len(self.places) < 2 or self.places[0] < 0:
            return False
        return all(b == a + len(t) for a, b, t in zip(self.places, self.places[1:], self.tiles))

    def whole(self, mean: int) -> Task:
        """The whole read near the chain."""
        found = [i for i, p in enumerate(self.places) if p >= 0]
        return Task(self.ref, self.read, max(0, self.places[found[0]] - mean), min(self.ref.length - 1, self.places[found[-1]] + len(self.tiles[found[-1]]) + mean))


def joined(tiles: list[str], parts: list[tuple[int, Mapping | None]], limit: int) -> tuple[Mapping | None, bool]:
    """The mapping put together from the segments of a chain, and whether it is uncertain; None if that fails.

    An empty middle segment is left out; the ones behind it then go with the tile before theirs.
    """
    k = len(tiles)
    if any(part is None for turn, (i, part) in enumerate(parts) if turn == 0 or i == k - 1):
        return None, True
    kept = [part for _, part in parts if part is not None]
    merged, end, unsure = Mapping(kept[0].position), kept[0].position, False
    for i, part in enumerate(kept):
        if end != part.position:
            off = part.position - end
            part.add("D" if off > 0 else "I", end + 2, abs(off))
            if abs(off) >= limit:
                return None, True
            unsure = True
        after = end + len(tiles[min(i, k - 1)]) + part.adjust()
        unsure = unsure or any(p <= end + 1 or p >= after - 1 for _, p, _ in part.indels) or any(p <= end + 2 or p >= after - 2 for p in part.mismatches)
        if part.position >= 0:
            merged.position = min(merged.position, part.position)
            for p, b in part.mismatches.items():
                merged.mismatches.setdefault(p, b)
            for indel in part.indels:
                merged.add(*indel)
        end = after
    return merged, unsure


def place_many(chains: list[Chain], mean: int, config: AlignConfig = DEFAULT) -> list[tuple[Mapping | None, bool]]:
    """The mapping of a read along each chain, and whether computing it failed.

    The quick one, put together from the chain's segments, where it is certain, else the better of it and an
    alignment of the whole read near the chain. That alignment's errors can reject the chain. All segments of all
    chains are aligned together, then all whole reads. A window of negative size is a failure of its chain.
    """
    plain = [c.straight() for c in chains]
    parts = [[] if plain[c] else chain.segments(mean) for c, chain in enumerate(chains)]
    failed = [any(isinstance(x, Task) and x.rows < -1 for _, x in p) for p in parts]
    where = [(c, s) for c, p in enumerate(parts) if not failed[c] for s, (_, x) in enumerate(p) if isinstance(x, Task)]
    for (c, s), got in zip(where, align_many([parts[c][s][1] for c, s in where], config.max_gap, config.tolerance)):
        parts[c][s] = (parts[c][s][0], got)
    quick = [(Mapping(chains[c].places[0]), False) if plain[c] else (None, True) if failed[c] else joined(chains[c].tiles, parts[c], config.repair_limit) for c in range(len(chains))]
    again = [c for c, (m, unsure) in enumerate(quick) if not failed[c] and (m is None or unsure)]
    tasks = {c: chains[c].whole(mean) for c in again}
    for c in again:
        failed[c] = tasks[c].rows < -1
    again = [c for c in again if not failed[c]]
    out = [(None if failed[c] else quick[c][0], failed[c]) for c in range(len(chains))]
    for c, whole in zip(again, align_many([tasks[c] for c in again], config.accurate_max_gap, config.tolerance)):
        first = quick[c][0]
        if whole is not None and whole.errors() >= config.reject_errors:
            out[c] = (None, False)
        elif whole is not None and (first is None or first.errors() >= whole.errors()):
            out[c] = (whole, False)
    return out


def drawn(ref: Window, read: str, mapping: Mapping, around: int = 10) -> tuple[str, str]:
    """Two lines that show a mapping: reference and read, gaps as '-'."""
    top, low, i, j = [], [], mapping.position, 0
    gaps = {p: (t, n) for t, p, n in mapping.indels}
    while j < len(read):
        while i in gaps and j < len(read):
            kind, n = gaps.pop(i)
            if kind == "I":
                top += "-" * min(n, len(read) - j)
                low += read[j : j + n]
                j += n
                continue
            top += [ref.base(x) for x in range(i, i + n)]
            low += "-" * n
            i += n
        if j < len(read):
            top.append(ref.base(i))
            low.append(read[j])
            i, j = i + 1, j + 1
    before = "".join(ref.base(x) for x in range(max(ref.start, mapping.position - around), max(ref.start, mapping.position)))
    behind = "".join(ref.base(x) for x in range(i, min(i + around, ref.start + len(ref.text))))
    return before + "".join(top) + behind, " " * len(before) + "".join(low)
