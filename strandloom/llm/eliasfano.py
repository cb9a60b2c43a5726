"""Elias-Fano coded ascending sequences in flat files, read and searched at many places at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORD = 64
#: Low parts of these many bytes are plain numbers; others are rows of bytes.
PLAIN = {1: np.uint8, 2: np.uint16, 4: np.uint32}
#: Of each byte, the places of its ones, then of its zeros.
ONES_FIRST = np.argsort(1 - np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"), axis=1, kind="stable")


def encode(values: np.ndarray, low_bits: int | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of low bits (a multiple of 8, at most 56), low parts, and high parts as a bit vector of 64-bit words.

    The bit vector holds a one for each value and a zero at the end of each bucket of equal high parts.
    ``values`` are ascending unsigned numbers.
    """
    n = len(values)
    values = values.astype(np.uint64)
    if low_bits is None:
        spread = int(values[-1]) // max(1, n) if n else 0
        low_bits = min(56, -(-max(1, spread.bit_length()) // 8) * 8)
        low_bits = 32 if low_bits == 24 else low_bits
    width = low_bits // 8
    if width in PLAIN:
        low = (values & np.uint64((1 << low_bits) - 1)).astype(PLAIN[width])
    else:
        low = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width])
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    size = n + (int(high[-1]) if n else 0) + 1
    bits = np.zeros(-(-size // WORD) * WORD, np.uint8)
    bits[high + np.arange(n)] = 1
    return low_bits, low, np.packbits(bits, bitorder="little").view(np.uint64)


def directory(high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ones and zeros before each word of the bit vector, and in all of it."""
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
    return ones.astype(np.uint32), (np.arange(len(ones)) * WORD - ones).astype(np.uint32)


def nth_one(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place of the one that has ``n`` ones before it, in each word."""
    parts = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
    count = np.bitwise_count(parts)
    upto = np.cumsum(count, axis=1, dtype=np.int16)
    byte = np.minimum((upto <= n[:, None]).sum(axis=1), 7)
    row = np.arange(len(parts))
    return byte * 8 + ONES_FIRST[parts[row, byte], np.minimum(n - (upto[row, byte] - count[row, byte]), 7)]


class Sequence:
    """Reads what ``encode`` made; the arrays may be memory maps. Without a directory, one is made."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray | None = None, zeros: np.ndarray | None = None):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.ones, self.zeros = directory(high) if ones is None else (ones, zeros)

    def lows(self, at: np.ndarray) -> np.ndarray:
        part = self.low[at]
        if part.ndim == 1:
            return part.astype(np.int64)
        return (part.astype(np.int64) << (8 * np.arange(part.shape[1]))).sum(axis=1)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at the places ``at``, as 64-bit unsigned numbers."""
        word = np.searchsorted(self.ones, at.astype(np.uint32), side="right") - 1
        place = nth_one(self.high[word], at - self.ones[word].astype(np.int64))
        return (word * WORD + place - at).astype(np.uint64) << np.uint64(self.low_bits) | self.lows(at).astype(np.uint64)

    def bucket_end(self, bucket: np.ndarray) -> np.ndarray:
        """Number of values in buckets up to and including each of ``bucket``: where its zero stands, less the zeros."""
        word = np.minimum(np.searchsorted(self.zeros, bucket.astype(np.uint32), side="right") - 1, len(self.high) - 1)
        place = nth_one(~self.high[word], bucket - self.zeros[word].astype(np.int64))
        return np.minimum(word * WORD + place - bucket, self.n)

    def find(self, values: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Position of each of ``values`` (ascending or not), -1 where absent.

        Given ``start`` and ``stop``, each value is sought only in its own run of positions, up to but without ``stop``.
        """
        out = np.full(len(values), -1, np.int64)
        for at in range(0, len(values), 1 << 16):
            v = values[at : at + (1 << 16)].astype(np.uint64)
            bucket = (v >> np.uint64(self.low_bits)).astype(np.int64)
            fits = np.flatnonzero(bucket < int(self.zeros[-1]))
            if not self.n or not len(fits):
                continue
            bucket, low = bucket[fits], (v[fits] & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)
            right = self.bucket_end(bucket)
            left = np.where(bucket > 0, self.bucket_end(np.maximum(bucket - 1, 0)), 0)
            if start is not None:
                left, right = np.maximum(left, start[at + fits]), np.minimum(right, stop[at + fits])
            end = right.copy()
            while (open_ := left < right).any():  # the first low part that isn't below
                mid = (left + right) // 2
                below = open_ & (self.lows(np.minimum(mid, self.n - 1)) < low)
                left, right = np.where(below, mid + 1, left), np.where(open_ & ~below, mid, right)
            hit = (left < end) & (self.lows(np.minimum(left, self.n - 1)) == low)
            out[at + fits[hit]] = left[hit]
        return out


def files(values: np.ndarray) -> dict[str, np.ndarray]:
    """The flat files of a sequence by their endings."""
    _, low, high = encode(values)
    ones, zeros = directory(high)
    return {"low": low, "high": high, "ones": ones, "zeros": zeros}


@lru_cache(maxsize=4096)
def mapped(path: str, n: int) -> Sequence:
    """The sequence of ``n`` values in the files ``path``.*, mapped into memory."""
    low = np.memmap(f"{path}.low", np.uint8, "r")
    width = len(low) // n
    low = low.view(PLAIN[width]) if width in PLAIN else low.reshape(n, width)
    return Sequence(n, 8 * width, low, np.memmap(f"{path}.high", np.uint64, "r"), *(np.memmap(f"{path}.{x}", np.uint32, "r") for x in ("ones", "zeros")))
