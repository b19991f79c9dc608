"""AVI files as other tools write them: standard tables, colour, several streams, dropped frames, damage."""

import hashlib
import struct
import time

import numpy as np
import pytest

from voxloom.llm import avi


def codes(kind, number):
    counts, symbols = avi.STANDARD[kind, number]
    out, code, at = {}, 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[symbols[at]] = f"{code:0{n}b}"
            code, at = code + 1, at + 1
        code *= 2
    return out


def value(v):
    s = abs(v).bit_length()
    return f"{v if v > 0 else v + (1 << s) - 1:0{s}b}" if s else ""


def block(zigzag, last, dc, ac):
    """Bits of a block of 64 integers."""
    d = zigzag[0] - last
    out, run = [dc[abs(d).bit_length()] + value(d)], 0
    for v in zigzag[1:]:
        if not v:
            run += 1
            continue
        while run > 15:
            out.append(ac[0xF0])
            run -= 16
        out.append(ac[run << 4 | abs(v).bit_length()] + value(v))
        run = 0
    return "".join(out) + (ac[0] if run else "")


def frame(planes, width, height, factors, restart=0, tables=True):
    """A baseline frame: planes of quantised zigzag blocks [rows, columns, 64], in colour 4:2:0 or gray."""
    n = len(planes)
    hmax, vmax = (1, 1) if n == 1 else (max(h for h, _ in factors), max(v for _, v in factors))
    mx, my = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    parts, bits, last = [], [], [0] * n
    for unit in range(mx * my):
        if restart and unit and unit % restart == 0:
            parts.append("".join(bits))
            bits, last = [], [0] * n
        y, x = divmod(unit, mx)
        for i, (h, v) in enumerate(factors if n > 1 else [(1, 1)]):
            for by in range(v):
                for bx in range(h):
                    b = planes[i][y * v + by, x * h + bx].tolist()
                    bits.append(block(b, last[i], codes(0, min(i, 1)), codes(1, min(i, 1))))
                    last[i] = b[0]
    parts.append("".join(bits))
    raw = b""
    for k, s in enumerate(parts):
        s += "1" * (-len(s) % 8)
        raw += (b"" if not k else bytes([0xFF, 0xD0 + (k - 1) % 8])) + int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\0")
    seg = avi._segment
    dht = b"".join(seg(0xC4, bytes([kind << 4 | number]) + c + s) for (kind, number), (c, s) in avi.STANDARD.items()) if tables else b""
    return (
        b"\xff\xd8" + seg(0xDB, b"\0" + bytes(range(1, 65))) + (seg(0xDD, struct.pack(">H", restart)) if restart else b"")
        + seg(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors))) + dht
        + seg(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0x11 * min(i, 1)]) for i in range(n)) + bytes([0, 63, 0])) + raw + b"\xff\xd9"
    )


def plain_luma(blocks, width, height):
    """Samples by the definition of the inverse transform."""
    rows, cols, _ = blocks.shape
    out = np.zeros((rows * 8, cols * 8))
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    c = [np.sqrt(0.5)] + [1.0] * 7
    for r in range(rows):
        for q in range(cols):
            f = np.zeros((8, 8))
            for k, at in enumerate(order):
                f[at // 8, at % 8] = blocks[r, q, k] * (k + 1)
            for y in range(8):
                for x in range(8):
                    out[8 * r + y, 8 * q + x] = 128 + 0.25 * sum(c[u] * c[v] * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
    return np.clip(np.rint(out), 0, 255)[:height, :width]


def some(rng, rows, cols, few=6):
    b = np.zeros((rows, cols, 64), int)
    b[:, :, 0] = rng.integers(-400, 400, (rows, cols))
    for k in rng.integers(1, 64, few):
        b[:, :, k] = rng.integers(-9, 10, (rows, cols))
    return b


def container(*streams, fps=25, index=True):
    """An AVI of frame lists, one a stream, in turn."""
    movi, idx, at = [], [], 4
    for k in range(max(map(len, streams))):
        for n, frames in enumerate(streams):
            if k < len(frames):
                name = b"%02ddc" % n
                movi.append(avi._chunk(name, frames[k]))
                idx.append(struct.pack("<4sIII", name, 0x10, at, len(frames[k])))
                at += len(movi[-1])
    strl = b"".join(avi._chunk(b"LIST", b"strl" + avi._chunk(b"strh", struct.pack("<4s4sIHHIIIIIIII8x", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps * (n + 1), 0, len(s), 0, 0, 0))) for n, s in enumerate(streams))
    body = b"AVI " + avi._chunk(b"LIST", b"hdrl" + avi._chunk(b"avih", struct.pack("<10I16x", 1_000_000 // fps, 0, 0, 0, 0, 0, 1, 0, 0, 0)) + strl) + avi._chunk(b"LIST", b"movi" + b"".join(movi))
    return avi._chunk(b"RIFF", body + (avi._chunk(b"idx1", b"".join(idx)) if index else b""))


def read(spark, *media):
    df = spark.createDataFrame([(k, bytearray(m)) for k, m in enumerate(media)], "doc_id long, media binary")
    return sorted(avi.clips(df).collect(), key=lambda r: (r["doc_id"], -1 if r["stream"] is None else r["stream"], r["clip"]))


@pytest.mark.parametrize("tables", [True, False])
@pytest.mark.parametrize("restart", [0, 2])
def test_gray_and_colour(tables, restart):
    rng = np.random.default_rng(1)
    gray = some(rng, 2, 3)
    assert (avi.Jpeg(frame([gray], 21, 13, [(1, 1)], restart, tables)).luma() == plain_luma(gray, 21, 13)).all()
    y, cb, cr = some(rng, 4, 4), some(rng, 2, 2), some(rng, 2, 2)
    assert (avi.Jpeg(frame([y, cb, cr], 30, 27, [(2, 2), (1, 1), (1, 1)], restart, tables)).luma() == plain_luma(y, 30, 27)).all()


def test_large_frame_in_linear_time():
    rng = np.random.default_rng(2)
    b = rng.integers(-3, 4, (60, 64, 64))
    raw = frame([b], 512, 480, [(1, 1)])
    assert len(raw) > 100_000
    start = time.time()
    avi.Jpeg(raw * 1).luma()
    per_byte = (time.time() - start) / len(raw)
    assert per_byte * 320_000 < 2


def test_streams_dropped_frames_and_rates(spark):
    rng = np.random.default_rng(3)
    a, b = (frame([some(rng, 2, 2, 0) * 0 + v], 16, 16, [(1, 1)]) for v in (-90, 90))
    rows = read(spark, container([b"", a, b"", a, b, b""], [b, b, a]), container([a, b], index=False), container([]), container([b"", b""]))
    assert [(r["doc_id"], r["stream"], r["clip"], r["first_frame"], r["n_frames"], r["end_s"]) for r in rows] == [
        (0, 0, 0, 0, 4, 4 / 25), (0, 0, 1, 4, 2, 6 / 25), (0, 1, 0, 0, 2, 2 / 50), (0, 1, 1, 2, 1, 3 / 50), (1, 0, 0, 0, 1, 1 / 25), (1, 0, 1, 1, 1, 2 / 25),
    ]


def test_damage_gives_a_row(spark):
    rng = np.random.default_rng(4)
    good = frame([some(rng, 2, 2)], 16, 16, [(1, 1)])
    sof = good.index(b"\xff\xc0")
    damaged = [
        good[:sof] + good[sof + 2 + struct.unpack(">H", good[sof + 2 : sof + 4])[0] :],  # no frame header
        good[: sof + 11] + b"\0" + good[sof + 12 :],  # sampling factors of 0
        good[: sof + 5] + b"\xff\xff\xff\xff" + good[sof + 9 :],  # a size of 65535 x 65535
        good[: sof + 5] + b"\x10\0\x10\0" + good[sof + 9 :],  # more blocks than bits
        good[:-20], good[: sof + 3], b"\xff\xd8\xff\xda\0\2", b"\xff\xd8" + b"\xff" * 50, b"\xff\xd8\xff\xdb\0\0",
    ]
    nested = b"RIFF" + struct.pack("<I", 1 << 20) + b"AVI " + b"LIST\x04\x00\x00\x00strl" * 20_000
    files = [container([good, d]) for d in damaged] + [container([good])[:-60], b"RIFF\0\0\0\0AVI ", nested, b"junk"]
    rows = read(spark, *files)
    assert [(r["doc_id"], r["clip"]) for r in rows] == [(k, -1) for k in range(len(damaged))] + [(len(files) - 4, -1)] + [(len(files) - 1, -1)]


def test_random_bytes_never_raise(spark):
    rng = np.random.default_rng(5)
    media = container([frame([some(rng, 2, 2)], 16, 16, [(1, 1)])] * 3)
    files = []
    for _ in range(60):
        m = bytearray(media)
        for at in rng.integers(12, len(m), 4):
            m[at] = int(rng.integers(256))
        files.append(bytes(m))
    assert len({r["doc_id"] for r in read(spark, *files)}) >= 50


def test_features_by_definition(spark):
    text = "abc" * 900 + "\x7f" * 4000 + "zz" * 2500
    got = avi.stored_features(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    raw = avi.padded(text.encode())
    per = avi.WIDTH * avi.HEIGHT
    hist = []
    for at in range(0, len(raw), per):
        counts = [0] * 16
        for v in raw[at : at + per].ljust(per, b"\0"):
            counts[v * 16 // 256] += 1
        hist.append([c / per for c in counts])
    diff = [0.0] + [sum(abs(x - y) for x, y in zip(a, b, strict=True)) / 2 for a, b in zip(hist, hist[1:], strict=False)]
    starts = [0]
    for i in range(1, len(diff)):
        seen = diff[max(starts[-1] + 1, i - avi.WINDOW) : i]
        mean = sum(seen) / len(seen) if seen else 0.0
        deviation = (max(0.0, sum(x * x for x in seen) / len(seen) - mean * mean)) ** 0.5 if seen else 0.0
        if diff[i] >= avi.FLOOR and diff[i] > mean + avi.SPREAD * deviation:
            starts.append(i)
    found = avi.shots(np.array(hist))
    assert [a for a, _, _ in found] == starts and [d for _, _, d in found] == pytest.approx([diff[a] for a in starts])
    digest = hashlib.sha256(np.array(hist).tobytes() + repr(found).encode()).hexdigest()[:16]
    assert got["feature"] == f"{len(hist)} frames, {len(starts)} clips, {digest}" and got["n_clips"] == len(starts) > 1
