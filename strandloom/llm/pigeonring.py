"""Pigeonring filtering of 64-bit fingerprints: segments on a ring, chains of them, and the join keys of candidates."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS, BITS = 9, 4


def segment_masks(segments: int = SEGMENTS) -> list[int]:
    """Masks of the segments: 64 bits in order, the last segment takes what is left."""
    width = 64 // segments
    masks = [((1 << width) - 1) << (width * i) for i in range(segments - 1)]
    return [*masks, ((1 << 64) - 1) ^ sum(masks)]


def chain_keys(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(start, mask) of the segments on which candidates of a chain from ``start`` agree.

    Of nine segments and four bits: offsets 0 and 1 have no difference. Of offsets 2 and 3 together at most one bit
    differs, and of 2 to 5 at most two, so at least two of these four are equal, one of them among the first two.
    Of two segments and one bit: one of the two is equal.
    """
    masks = segment_masks(segments)
    equal = {SEGMENTS: [(0, 1, *p) for p in combinations((2, 3, 4, 5), 2) if p[0] < 4], 2: [(0,)]}[segments]
    return [(i, sum(masks[(i + o) % segments] for o in e)) for i in range(segments) for e in equal]


def within_budgets(diff: np.ndarray, start: np.ndarray | int, segments: int = SEGMENTS, bits: int = BITS) -> np.ndarray:
    """Indexes of the differences that keep the budget of every chain from ``start``, the full distance last."""
    masks = np.array(segment_masks(segments), dtype=np.uint64)
    found, used = np.arange(len(diff)), np.zeros(len(diff), np.int64)
    for k in range(segments):
        used = used + np.bitwise_count(diff & masks[(start + k) % segments])
        ok = used * segments <= (k + 1) * bits
        found, used, diff = found[ok], used[ok], diff[ok]
        if isinstance(start, np.ndarray):
            start = start[ok]
        if not len(found):
            break
    return found


def key_structs(fingerprint: str, segments: int = SEGMENTS, base: Column | None = None) -> Column:
    """Array of key (the number of the chain key, counted from ``base``) and value of a fingerprint's join keys."""
    at = lambda k: F.lit(k).cast("int") if base is None else (base + k).cast("int")
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return F.array(*[F.struct(at(k).alias("key"), F.col(fingerprint).bitwiseAND(F.lit(signed(m))).alias("value")) for k, (_, m) in enumerate(chain_keys(segments))])
