import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import media


def one_by_one(block):
    """IMA ADPCM, sample by sample."""
    guess, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [guess]
    for byte in block[4:]:
        for nib in (byte & 15, byte >> 4):
            step = media.STEPS[index]
            size = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                size += part if nib & bit else 0
            guess = max(-32768, min(32767, guess - size if nib & 8 else guess + size))
            index = max(0, min(88, index + media.CHANGES[nib & 7]))
            out.append(guess)
    return out


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(min_size=20, max_size=20), max_size=6))
def test_adpcm(blocks):
    got = media.adpcm_decode(np.array([list(b) for b in blocks], np.uint8).reshape(-1, 20))
    assert got.tolist() == [one_by_one(b) for b in blocks]


def test_laws():
    mu, a = media.tables()["mulaw"], media.tables()["alaw"]
    assert (mu[0xFF], mu[0x7F], mu[0x80], mu[0x00]) == (0, 0, 32124, -32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(a.tolist())) == 256 and len(set(mu.tolist())) == 255


def test_resample():
    t = np.arange(4000)
    x = np.rint(9000 * np.sin(2 * np.pi * 300 * t / 8000)).astype(np.int16)
    y = media.resample(x)
    want = 9000 * np.sin(2 * np.pi * 300 * np.arange(8000) / 16000)
    assert len(y) == 8000 and np.abs(y - want)[50:-50].max() < 40
    assert len(media.resample(x, 8000, 11025)) == -(-4000 * 441 // 320)
    assert np.array_equal(media.resample(x, 8000, 8000), x)


@given(st.binary(max_size=500))
@settings(deadline=None)
def test_round_trip(text):
    p = media.pad(text)
    assert len(p) % 192 == 0 and len(p) >= 192 and p.startswith(text)
    for codec in media.TAGS:
        assert media.payload_of(*media.from_wav(media.to_wav(p, codec))) == p


def test_broken():
    with pytest.raises(ValueError):
        media.from_wav(b"RIFFxxxxWAVE")


def test_table(spark):
    rows = [(1, "hello", 3), (2, None, 3), (3, "", 3), (4, "é" * 70000, 3), (None, "hello", 3), (6, "x" * 192, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    df.write.mode("overwrite").parquet("/tmp/strandloom-media/documents.parquet")
    got = {r["doc_id"]: r for r in media.op1_telephony(spark, "/tmp/strandloom-media").collect()}
    for key, text, _ in rows:
        p = media.pad((text or "").encode())
        r = got[key]
        assert (r["n_bytes"], r["payload_bytes"]) == (len((text or "").encode()), len(p))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        m = media.to_wav(p, media.choose(p))
        assert (r["media_bytes"], r["media_sha256"]) == (len(m), hashlib.sha256(m).hexdigest())
    assert got[1]["feature"] == got[None]["feature"] and got[2]["feature"] == got[3]["feature"]
    pcm = {r["doc_id"]: r for r in media.decode_media(media.store_media(df)).collect()}
    assert all(f"{zlib.crc32(pcm[k]['pcm'])}" == got[k]["feature"].split(":")[-1] and len(pcm[k]["pcm"]) == got[k]["pcm_bytes"] for k in got)
    none = media.store_media(df.limit(0))
    assert none.collect() == [] and media.decode_media(none).collect() == []
    bad = spark.createDataFrame([(1, 2, b"nonsense"), (2, 2, None)], "doc_id long, n_bytes long, media binary")
    assert [(r["codec"], r["pcm"]) for r in media.decode_media(bad).collect()] == [(None, None)] * 2
