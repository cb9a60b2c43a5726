"""Plain versions of alignment and placement, cell by cell, to compare the batched ones with."""

from __future__ import annotations


def add(indels, kind, place, n):
    for k, (t, p, m) in enumerate(indels):
        if p == place:
            if t == kind:
                indels[k] = (t, p, m + n)
            return
    indels.append((kind, place, n))


def align(ref, read, left, right, max_gap, tolerance=4):
    """(position, mismatches, indels); None for an empty window."""
    n, m = right - left + 1, len(read)
    if n < -1:
        raise ValueError
    if n < 0:
        return None
    base = lambda i: ref[i] if 0 <= i < len(ref) else "\0"
    t = [[0] * (m + 1) for _ in range(n + 1)]
    back = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            match = t[i - 1][j - 1] + (2 if base(left + i - 1) == read[j - 1] else -2)
            gone, more, from_gone, from_more = -1, -1, (0, 0), (0, 0)
            for k in range(1, min(i, max_gap) + 1):
                if t[i - k][j] - k - 1 > gone:
                    gone, from_gone = t[i - k][j] - k - 1, (i - k, j)
            for k in range(1, min(j, max_gap) + 1):
                if t[i][j - k] - k - 1 > more:
                    more, from_more = t[i][j - k] - k - 1, (i, j - k)
            best = max(match, gone, more)
            if best < 0:
                t[i][j] = -1
            elif best == match:
                t[i][j], back[i][j] = match, (i - 1, j - 1)
            elif best == gone:
                t[i][j], back[i][j] = gone, from_gone
            else:
                t[i][j], back[i][j] = more, from_more
    last = [row[m] for row in t]
    top = max(last)
    ends = [i for i in range(n + 1) if last[i] == top] + [i for i in range(n + 1) if top - tolerance <= last[i] < top]
    found = []
    for end in ends:
        i, j, seen, wrong, indels = end, m, (0, 0), {}, []
        while i > 0 and j > 0:
            seen, (a, b) = (i, j), back[i][j]
            if b == j:
                add(indels, "D", left + a, i - a)
            elif a == i:
                add(indels, "I", left + i, j - b)
            elif base(left + i - 1) != read[j - 1]:
                wrong.setdefault(left + i - 1, read[j - 1])
            i, j = a, b
        if seen[1] > 1:
            add(indels, "I", left, seen[1] - 1)
        found.append((left + seen[0] - 1, wrong, indels))
    return min(found, key=lambda x: (errors(x), len(x[2])))


def errors(mapping):
    return len(mapping[1]) + sum(n for _, _, n in mapping[2])


def adjust(mapping):
    return sum(n if t == "D" else -n for t, _, n in mapping[2])


def place(ref, read, chain, tiles, mean, gap=25, near_gap=1, limit=5, reject=8):
    """The mapping of a read along a chain, or None; ValueError if a window is out of order."""
    k, parts = len(chain), []

    def quick():
        for turn, i in enumerate([0, *range(1, k - 1), k - 1]):
            if chain[i] >= 0:
                parts.append((chain[i], {}, []))
                continue
            if turn == 0:
                a, b = max(0, chain[1] - mean - len(tiles[0])), chain[1]
            elif i == k - 1:
                a = chain[i - 1] + len(tiles[i - 1])
                b = min(len(ref), a + mean)
            else:
                a, b = chain[i - 1] + len(tiles[i - 1]), chain[i + 1]
            part = align(ref, tiles[i], a, b, gap)
            if part is not None:
                parts.append(part)
            elif turn == 0 or i == k - 1:
                return None, True
        position, wrong, indels, end, unsure = parts[0][0], {}, [], parts[0][0], False
        for i, (p, w, x) in enumerate(parts):
            if end != p:
                add(x, "D" if p > end else "I", end + 2, abs(p - end))
                if abs(p - end) >= limit:
                    return None, True
                unsure = True
            after = end + len(tiles[min(i, k - 1)]) + adjust((p, w, x))
            unsure = unsure or any(q <= end + 1 or q >= after - 1 for _, q, _ in x) or any(q <= end + 2 or q >= after - 2 for q in w)
            if p >= 0:
                position = min(position, p)
                for q, b in w.items():
                    wrong.setdefault(q, b)
                for t, q, n in x:
                    add(indels, t, q, n)
            end = after
        return (position, wrong, indels), unsure

    first, unsure = quick()
    if first is not None and not unsure:
        return first
    found = [i for i, p in enumerate(chain) if p >= 0]
    whole = align(ref, read, max(0, chain[found[0]] - mean), min(len(ref) - 1, chain[found[-1]] + len(tiles[found[-1]]) + mean), near_gap)
    if whole is None:
        return first
    if errors(whole) >= reject:
        return None
    return first if first is not None and errors(first) < errors(whole) else whole
