"""AVI motion-JPEG: lossless storage, general decoding, shots."""

import hashlib
import os
import struct
import zlib

import numpy as np
import pytest

from voxloom.llm import avi

SCHEMA = "doc_id long, text string, media string"


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, value, n):
        if n:
            self.s += f"{value:0{n}b}"

    def bytes(self):
        s = self.s + "1" * (-len(self.s) % 8)
        return int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\0") if s else b""


#: Plain tables: category s has the 4-bit code s; AC has end of block as 00 and (run 0, size 1) as 01.
DC = (bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12)))
AC = (bytes([0, 2] + [0] * 14), bytes([0x00, 0x01]))


def signed(bits, v):
    s = abs(v).bit_length()
    bits.put(s, 4)
    bits.put(v if v > 0 else v + (1 << s) - 1, s)


def baseline(blocks):
    """A gray baseline frame one block high; each block is (DC value, first AC coefficient -1..1)."""
    bits, last = Bits(), 0
    for dc, ac in blocks:
        signed(bits, dc - last)
        last = dc
        if ac:
            bits.put(1, 2)
            bits.put(1 if ac > 0 else 0, 1)
        bits.put(0, 2)
    seg = avi._segment
    return (
        b"\xff\xd8" + seg(0xDB, b"\0" + bytes([8] * 64)) + seg(0xC0, struct.pack(">BHHBBBB", 8, 8, 8 * len(blocks), 1, 1, 0x11, 0)) + seg(0xC4, b"\0" + DC[0] + DC[1]) + seg(0xC4, b"\x10" + AC[0] + AC[1])
        + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + bits.bytes() + b"\xff\xd9"
    )


def test_baseline_frames():
    found = avi.Jpeg(baseline([(-20, 0), (50, 0), (0, 1)])).luma()
    assert (found[:, :8] == 108).all() and (found[:, 8:16] == 178).all()
    wave = 128 + 8 * np.sqrt(0.125) * 0.5 * np.cos((2 * np.arange(8) + 1) * np.pi / 16)
    assert np.abs(found[0, 16:].astype(float) - wave).max() <= 0.51


def test_zigzag():
    assert avi.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and avi.ZIGZAG[-1] == 63


@pytest.mark.parametrize("n", [64, 128, 2048, 2112, 6400, 99968])
def test_lossless_storage(n):
    payload = os.urandom(n)
    media = avi.encode_avi(payload)
    found, frames = avi.decode_avi(media)
    assert b"".join(f.tobytes() for f in frames)[: found.payload] == payload
    jpeg = avi.Jpeg(media[found.frames[0][0] :][: found.frames[0][1]])
    assert jpeg.uniform and (jpeg._lossless() == frames[0]).all()  # symbol by symbol, too


def test_without_index():
    media = avi.encode_avi(b"a" * 5000)
    at = media.index(b"idx1")
    cut = media[:4] + struct.pack("<I", at - 8) + media[8:at]
    assert len(avi.Avi(cut).frames) == 3 and avi.Avi(cut).frames == avi.Avi(media).frames


def test_shots_adapt():
    rng = np.random.default_rng(0)
    quiet = [np.full((8, 8), 40) + rng.integers(0, 30, (8, 8)) for _ in range(10)]
    bright = [np.full((8, 8), 180) + rng.integers(0, 30, (8, 8)) for _ in range(7)]
    found = avi.shots(avi.histograms([f.astype(np.uint8) for f in [*quiet, *bright, *quiet]]), floor=0.3)
    assert [(a, b) for a, b, _ in found] == [(0, 10), (10, 17), (17, 27)]
    assert avi.shots(np.zeros((0, 16))) == []


def test_clips(spark):
    stored = avi.store_texts(spark.createDataFrame([(1, "dark" * 2000, "x"), (2, None, "x"), (None, "z", "x")], SCHEMA))
    rows = avi.clips(stored).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, None} and all(r["end_s"] == pytest.approx((r["first_frame"] + r["n_frames"]) / 25) for r in rows)
    odd = spark.createDataFrame([(1, bytearray(b"junk")), (2, None), (3, bytearray())], "doc_id long, media binary")
    assert [(r["doc_id"], r["clip"]) for r in avi.clips(odd).collect()] == [(1, -1)]


def test_stored_features(spark):
    rows = [(1, None), (2, ""), (3, "abc"), (4, "é" * 64), (5, "q" * 30_000), (6, "abc"), (None, "abc")]
    got = avi.stored_features(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), rows, strict=True):
        raw = (t or "").encode()
        payload = avi.padded(raw)
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (i, len(raw), len(payload)) and len(payload) % 64 == 0 and len(payload) > 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        media = avi.encode_avi(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert avi.stored_features(spark.createDataFrame([], SCHEMA)).count() == 0
