"""Telephony audio in tables: 8-bit mu-law and A-law and 4-bit ADPCM, kept as WAV files and decoded to resampled PCM.

Companded samples are expanded by lookup tables. ADPCM blocks start from a state of their own, so numpy steps
through the samples of all blocks of a batch at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import slices, table

RATE, TARGET_RATE = 8000, 16000
#: Payload bytes are padded to a multiple of this, which is also what one ADPCM block carries.
UNIT = 192
#: Format tags of the WAV header (fixed values).
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
CODECS = {v: k for k, v in TAGS.items()}
#: Step sizes and index changes of IMA ADPCM (fixed values).
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
CHANGES = (-1, -1, -1, -1, 2, 4, 6, 8)


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """PCM16 values of all 256 codes, by law."""
    code = np.arange(256)
    inv = ~code & 0xFF
    size = ((((inv & 15) << 3) + 132) << (inv >> 4 & 7)) - 132
    mulaw = np.where(inv & 128, -size, size)
    flip = code ^ 0x55
    part, low = flip >> 4 & 7, (flip & 15) << 4
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    alaw = np.where(flip & 128, size, -size)
    return {"mulaw": mulaw.astype(np.int16), "alaw": alaw.astype(np.int16)}


@lru_cache(maxsize=1)
def adpcm_moves() -> tuple[np.ndarray, np.ndarray]:
    """For step index * 16 + nibble: the change of the predictor, and the next step index * 16."""
    step, nib = np.array(STEPS)[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(nib & 4, step, 0) + np.where(nib & 2, step >> 1, 0) + np.where(nib & 1, step >> 2, 0)
    after = np.clip(np.arange(len(STEPS))[:, None] + np.array(CHANGES)[nib & 7], 0, len(STEPS) - 1)
    return np.where(nib & 8, -size, size).astype(np.int32).ravel(), (after * 16).astype(np.int32).ravel()


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """PCM16 of IMA ADPCM blocks (rows of bytes: predictor, index, 0, then two samples a byte, low half first)."""
    if not len(blocks):
        return np.zeros((0, 2 * blocks.shape[1] - 7), np.int16)
    move, after = adpcm_moves()
    guess = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1) * 16
    data = blocks[:, 4:].T
    out = np.empty((1 + 2 * len(data), len(blocks)), np.int16)
    out[0] = guess
    for k, byte in enumerate(data):
        for half in range(2):
            at = index + (byte >> 4 if half else byte & 15)
            guess = np.clip(guess + move[at], -32768, 32767)
            index = after[at]
            out[1 + 2 * k + half] = guess
    return out.T


@lru_cache(maxsize=16)
def kernel(up: int, down: int, taps: int = 16) -> np.ndarray:
    """``up`` rows of a windowed-sinc filter, one for each place of an output sample between two input samples."""
    wide = max(1.0, down / up)
    half = int(np.ceil(taps / 2 * wide))
    at = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    rows = np.sinc(at / wide) * np.cos(np.pi * at / (2 * half + 2)) ** 2
    return (rows / rows.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(pcm: np.ndarray, source: int = RATE, target: int = TARGET_RATE) -> np.ndarray:
    """PCM16 at another rate: ceil(n * target / source) samples."""
    up, down = target // gcd(source, target), source // gcd(source, target)
    n = -(-len(pcm) * up // down)
    rows = kernel(up, down)
    half = rows.shape[1] // 2
    x = np.zeros(len(pcm) + 2 * half, np.float32)
    x[half - 1 : half - 1 + len(pcm)] = pcm
    out = np.empty(n, np.int16)
    for first in range(min(up, n)):
        count = len(range(first, n, up))
        start, place = divmod(first * down, up)
        if place == 0 and down == 1:  # falls on input samples
            out[first::up] = pcm[start : start + count]
            continue
        y = np.zeros(count, np.float32)
        for tap, weight in enumerate(rows[place]):
            y += weight * x[start + tap : start + tap + (count - 1) * down + 1 : down]
        out[first::up] = np.clip(np.rint(y), -32768, 32767)
    return out


def pad(text: bytes) -> bytes:
    """``text`` and blanks (byte 32) up to a positive multiple of ``UNIT``."""
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def choose(payload: bytes) -> str:
    """The law in which a payload is stored; it depends on the payload alone."""
    return ("mulaw", "alaw", "adpcm")[zlib.crc32(payload) % 3]


def to_wav(payload: bytes, codec: str) -> bytes:
    """A WAV file whose samples are the payload: bytes as 8-bit codes, or as pairs of 4-bit codes in ADPCM blocks."""
    if codec == "adpcm":
        blocks = np.zeros((len(payload) // UNIT, UNIT + 4), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, align, bits, each = blocks.tobytes(), UNIT + 4, 4, 2 * UNIT + 1
        extra = struct.pack("<HH", 2, each)
        count = len(blocks) * each
    else:
        data, align, bits, each, extra, count = payload, 1, 8, 1, struct.pack("<H", 0), len(payload)
    form = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, RATE * align // each, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(media: bytes) -> tuple[str, int, bytes]:
    """Codec, block size and sample bytes of a WAV file. ValueError on anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, align = 12, None, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag, align = int.from_bytes(media[at + 8 : at + 10], "little"), int.from_bytes(media[at + 20 : at + 22], "little")
        elif name == b"data" and tag in CODECS:
            return CODECS[tag], align, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples of a telephony format")


def payload_of(codec: str, align: int, data: bytes) -> bytes:
    """The payload that ``to_wav`` stored."""
    return np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes() if codec == "adpcm" else data


def decode_all(files: list[tuple[str, int, bytes]]) -> list[np.ndarray]:
    """PCM16 of each file; ADPCM blocks of one size are decoded together, over all files."""
    out: list = [None] * len(files)
    groups: dict[int, list[int]] = {}
    for i, (codec, align, data) in enumerate(files):
        if codec == "adpcm":
            groups.setdefault(align, []).append(i)
        else:
            out[i] = tables()[codec][np.frombuffer(data, np.uint8)]
    for align, members in groups.items():
        blocks = [np.frombuffer(files[i][2], np.uint8)[: len(files[i][2]) // align * align].reshape(-1, align) for i in members]
        pcm, at = adpcm_decode(np.concatenate(blocks)), 0
        for i, b in zip(members, blocks):
            out[i] = pcm[at : at + len(b)].ravel()
            at += len(b)
    return out


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a WAV file): each whole text as telephony audio, however long. Null text: as an empty one.

    Each row has its own file, so equal texts have equal ones. No rows: no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            wavs = [to_wav(p := pad(t), choose(p)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(wavs, pa.binary())], ["doc_id", "n_bytes", "media"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_media(files: DataFrame, rate: int = TARGET_RATE) -> DataFrame:
    """The columns doc_id and n_bytes, codec, and pcm: the samples of ``media`` as little-endian PCM16 at ``rate``.

    A null or broken file gives null codec and pcm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 2 << 20):
            read = [readable(m) for m in batch.column("media").to_pylist()]
            good = iter(decode_all([x for x in read if x]))
            pcm = [resample(next(good), RATE, rate).astype("<i2").tobytes() if x else None for x in read]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array([x[0] if x else None for x in read], pa.string()), pa.array(pcm, pa.binary())], ["doc_id", "n_bytes", "codec", "pcm"])

    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, codec string, pcm binary")


def readable(media: bytes | None) -> tuple[str, int, bytes] | None:
    try:
        return from_wav(media) if media is not None else None
    except ValueError:
        return None


def feature(codec: str, pcm: np.ndarray, out: np.ndarray) -> str:
    """codec, samples, peak, sign changes and energy of the decoded samples, and the CRC-32 of the resampled ones."""
    wide = pcm.astype(np.int64)
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec}:{len(pcm)}:{int(np.abs(wide).max())}:{turns}:{int(wide @ wide)}:{zlib.crc32(out.astype('<i2').tobytes())}"


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media", 2 << 20):
        files = batch.column("media").to_pylist()
        read = [from_wav(m) for m in files]
        rows = []
        for m, f, pcm in zip(files, read, decode_all(read)):
            p = payload_of(*f)
            out = resample(pcm)
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(f[0], pcm, out), 2 * len(out)))
        cols = [pa.array(x) for x in zip(*rows)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *cols], DIGEST_NAMES)


DIGEST_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes"]


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what ``store_media`` keeps for every document, read back, decoded and resampled."""
    return store_media(table(spark, sf_dir, "documents")).mapInArrow(digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long")
