"""AVI motion-JPEG: container, intra frames and shots.

``Avi`` reads a RIFF AVI file by its index, ``pictures`` decodes a stream's motion-JPEG frames
(baseline DCT or lossless process, ITU T.81) one after another and ``shots`` cuts the frames where the difference of neighbouring
luma histograms exceeds a threshold that adapts to the differences before it. ``clips`` yields one
timed row for each shot of each media value of a table.

``encode_avi`` stores bytes as 8-bit samples, losslessly: 64 samples a line, left-neighbour
prediction, and a Huffman table in which category s has a code of 9 - s bits, so that every
sample takes 9 bits and whole frames pack and unpack as arrays. The decoder sees that property
in the table it reads; any other table is decoded symbol by symbol.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.base import map_rows, table, texts

WIDTH, HEIGHT, FPS = 64, 32, 25
BINS = 16
#: A cut: a histogram difference of at least FLOOR that exceeds mean + SPREAD * deviation of up to WINDOW differences
#: before it in its shot.
WINDOW, SPREAD, FLOOR = 8, 3.0, 0.05

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


# --- storing -------------------------------------------------------------------------------------


def _uniform_codes() -> np.ndarray:
    """9-bit code of each difference -255..255."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = (1 << (9 - s)) - 2  # 8 - s ones and a zero
        out[d + 255] = prefix << s | (d if d > 0 else d + (1 << s) - 1)
    return out


_CODES = _uniform_codes()
_DIFFS = np.zeros(512, np.int16)
_DIFFS[_CODES] = np.arange(-255, 256)
_SHIFTS = np.arange(8)


def _pack9(codes: np.ndarray) -> np.ndarray:
    """9-bit codes, eight to nine bytes, most significant bit first."""
    c = codes.reshape(-1, 8).astype(np.uint16)
    out = np.empty((len(c), 9), np.uint8)
    out[:, 0] = c[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = (c[:, k - 1] << (8 - k) & 0xFF) | (c[:, k] >> (k + 1))
    out[:, 8] = c[:, 7] & 0xFF
    return out


def _unpack9(raw: np.ndarray) -> np.ndarray:
    b = raw.reshape(-1, 9).astype(np.uint16)
    return ((b[:, :8] << (_SHIFTS + 1).astype(np.uint16) & 0x1FF) | (b[:, 1:] >> (7 - _SHIFTS).astype(np.uint16))).reshape(-1)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head(width: int, height: int) -> bytes:
    table = bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    return (
        b"\xff\xd8"
        + _segment(0xC3, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + table)
        + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
    )


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode_avi(payload: bytes, width: int = WIDTH, height: int = HEIGHT, fps: int = FPS) -> bytes:
    """An AVI file whose lossless motion-JPEG frames hold the bytes as samples, row by row; the
    last frame is filled with zeros and the length stands in the file's comment."""
    per = width * height
    n = max(1, -(-len(payload) // per))
    pix = np.zeros(n * per, np.uint8)
    pix[: len(payload)] = np.frombuffer(payload, np.uint8)
    pix = pix.reshape(n, height, width)
    before = np.empty_like(pix)
    before[:, :, 1:] = pix[:, :, :-1]
    before[:, 1:, 0] = pix[:, :-1, 0]
    before[:, 0, 0] = 128
    packed = _pack9(_CODES[pix.astype(np.int16) - before + 255]).tobytes()
    size, head = per * 9 // 8, _jpeg_head(width, height)
    movi, index, at = [], [], 4
    for k in range(n):
        frame = head + packed[k * size : (k + 1) * size].replace(b"\xff", b"\xff\0") + b"\xff\xd9"
        movi.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(movi[-1])
    longest = max(map(len, movi))
    avih = struct.pack("<10I16x", 1_000_000 // fps, longest * fps, 0, 0x10, n, 0, 1, longest, width, height)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, n, longest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", per, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d" % len(payload)))
    body = b"AVI " + hdrl + info + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


# --- reading -------------------------------------------------------------------------------------

#: A frame with more samples than this is not decoded.
MOST_PIXELS = 1 << 25
#: Frames of the uniform kind that are decoded together.
TOGETHER = 512


class Avi:
    """Parsed container: the video streams' frames as (offset, length), from the index, or from the
    chunks where there is none or the file goes on beyond its first part; each stream's frames a
    second; and the payload length where the comment names one. Lists are entered in one pass over
    the chunks, so neither nesting nor size costs more than the file's length."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
            raise ValueError("not an AVI file")
        self.data, self.payload = data, None
        self.streams: dict[int, list[tuple[int, int]]] = {}
        rates: list[float | None] = []
        default, movi, index, more, chunks, at = float(FPS), 0, b"", False, [], 12
        while at + 8 <= len(data):
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body, stop = at + 8, min(len(data), at + 8 + size)
            if name in (b"LIST", b"RIFF"):
                movi = movi or (body if data[body : body + 4] == b"movi" else 0)
                more |= name == b"RIFF"
                at = body + 4
                continue
            if name == b"avih" and size >= 4:
                default = 1e6 / max(1, struct.unpack_from("<I", data, body)[0])
            elif name == b"strh" and stop - body >= 28:
                scale, rate = struct.unpack_from("<II", data, body + 20)
                rates.append(rate / scale if data[body : body + 4] == b"vids" and rate and scale else None)
            elif name == b"ICMT" and data[body:stop].startswith(b"payload="):
                self.payload = int(data[body + 8 : stop].rstrip(b"\0"))
            elif name == b"idx1":
                index = data[body:stop]
            elif name[2:] in (b"dc", b"db") and name[:2].isdigit():
                chunks.append((int(name[:2]), body, stop - body))
            at = body + size + size % 2
        if index and not more:
            entries = list(struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]))
            # offsets count from the movi list's name, in some files from the file's start
            base = movi if entries and data[movi + entries[0][2] : movi + entries[0][2] + 4] == entries[0][0] else 0
            chunks = [(int(name[:2]), base + at + 8, size) for name, _, at, size in entries if name[2:] in (b"dc", b"db") and name[:2].isdigit()]
        for stream, at, size in chunks:
            self.streams.setdefault(stream, []).append((at, size))
        self._rates = {k: r for k, r in enumerate(rates) if r}
        self._default = default

    def fps(self, stream: int) -> float:
        return self._rates.get(stream, self._default)

    @property
    def frames(self) -> list[tuple[int, int]]:
        """Frames of the first stream."""
        return self.streams.get(0, [])


@functools.lru_cache(maxsize=16)
def _lookup(counts: bytes, symbols: bytes) -> array:
    """For each 16 bits that may come next: length * 256 + symbol of the code they begin with, 0
    where they begin with none."""
    out, at, code = np.zeros(1 << 16, np.uint16), 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            if code >> n:
                raise ValueError("more codes than bits")
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return array("H", out.tobytes())


def _standard(counts: str, first: str) -> tuple[bytes, bytes]:
    """A table of run and size symbols: the named ones first, then all others in ascending order."""
    named = list(bytes.fromhex(first))
    return bytes.fromhex(counts), bytes(named + [r << 4 | s for r in range(16) for s in range(1, 11) if r << 4 | s not in named])


# The typical Huffman tables of ITU T.81, K.3, which motion-JPEG frames leave out.
STANDARD = {
    (0, 0): (bytes.fromhex("00010501010101010100000000000000"), bytes(range(12))),
    (0, 1): (bytes.fromhex("00030101010101010101010000000000"), bytes(range(12))),
    (1, 0): _standard("0002010303020403050504040000017d", "010203000411051221314106135161072271143281 91a1082342b1c11552d1f02433627282090a"),
    (1, 1): _standard("00020102040403040705040400010277", "0001020311040521310612415107617113223281 08144291a1b1c109233352f0156272d10a162434e125f1"),
}
_UNIFORM = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))
_BASIS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _windows(data: bytes) -> array:
    """The 32 bits that begin at each byte; zeros follow the end."""
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
    n = len(data) + 4
    return array("I", (raw[:n] << 24 | raw[1 : n + 1] << 16 | raw[2 : n + 2] << 8 | raw[3 : n + 3]).tobytes())


class Jpeg:
    """Headers of one frame and where its entropy-coded data stand."""

    def __init__(self, data: bytes):
        self.tables: dict[tuple[int, int], tuple[bytes, bytes]] = {}
        self.quant: dict[int, np.ndarray] = {}
        self.restart, self.parts, self.scan = 0, [], {}
        self.lossless = False
        at = 2
        while not self.scan:
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            size = data[at + 2] << 8 | data[at + 3]
            if size < 2:
                raise ValueError("segment without length")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC4:
                k = 0
                while k < len(body):
                    counts = body[k + 1 : k + 17]
                    n = sum(counts)
                    if len(counts) < 16 or k + 17 + n > len(body):
                        raise ValueError("short table")
                    self.tables[body[k] >> 4, body[k] & 15] = counts, body[k + 17 : k + 17 + n]
                    k += 17 + n
            elif marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    self.quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.float64)
                    k += 129 if wide else 65
            elif marker == 0xDD:
                self.restart = body[0] << 8 | body[1]
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                if marker not in (0xC0, 0xC1, 0xC3) or body[0] != 8:
                    raise ValueError("only 8-bit baseline and lossless Huffman frames")
                self.lossless = marker == 0xC3
                self.height, self.width = struct.unpack_from(">HH", body, 1)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif marker == 0xDA:
                self.scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                self.predictor, self.shift = body[1 + 2 * body[0]], body[3 + 2 * body[0]] & 15
                if not self.scan:
                    raise ValueError("empty scan")
        if not self.parts or not self.height or not self.width or self.height * self.width > MOST_PIXELS:
            raise ValueError("no frame header, or no size that is decoded")
        if any(not 1 <= f <= 4 for _, h, v, _ in self.parts for f in (h, v)):
            raise ValueError("sampling factors are 1 to 4")
        end = data.rfind(b"\xff\xd9")
        self.entropy = data[at : end if end > at else len(data)]
        # a sample costs a bit at least, a block two
        least = self.height * self.width if self.lossless else -(-self.height // 32) * -(-self.width // 32) * 2
        if 8 * len(self.entropy) < least:
            raise ValueError("frame is cut short")

    @property
    def uniform(self) -> bool:
        return self.lossless and len(self.parts) == 1 and self.predictor == 1 and not self.shift and not self.restart and self.tables.get((0, 0)) == _UNIFORM and self.width % 8 == 0

    def codes(self, kind: int, number: int) -> array:
        """Lookup of a frame's own table, or of the standard one where it has none."""
        return _lookup(*(self.tables.get((kind, number)) or STANDARD[kind, number]))

    def segments(self) -> list[bytes]:
        """Entropy-coded bytes between restart markers, without stuffing."""
        out, start, k, raw = [], 0, 0, self.entropy
        while (k := raw.find(b"\xff", k)) >= 0:
            if k + 1 < len(raw) and 0xD0 <= raw[k + 1] <= 0xD7:
                out.append(raw[start:k])
                start = k + 2
            k += 2
        return [s.replace(b"\xff\0", b"\xff") for s in [*out, raw[start:]]]

    def luma(self) -> np.ndarray:
        return self._lossless() if self.lossless else self._baseline()

    def _lossless(self) -> np.ndarray:
        if len(self.parts) != 1 or not 1 <= self.predictor <= 7 or self.shift:
            raise ValueError("lossless frames have one component, a predictor and whole samples here")
        h, w = self.height, self.width
        codes = self.codes(0, self.scan[self.parts[0][0]] >> 4)
        predict = (None, lambda a, b, c: b, lambda a, b, c: c, lambda a, b, c: a + b - c, lambda a, b, c: a + (b - c >> 1), lambda a, b, c: b + (a - c >> 1), lambda a, b, c: a + b >> 1)[self.predictor - 1]
        pix, segments, per = bytearray(h * w), self.segments(), self.restart or h * w
        if len(segments) < -(-h * w // per):
            raise ValueError("a restart interval is missing")
        for number, data in enumerate(segments):
            bits, p, first = _windows(data), 0, number * per
            for at in range(first, min(first + per, h * w)):
                if at == first:
                    held = 128
                elif at < first // w * w + w or (at % w and predict is None):
                    held = pix[at - 1]
                elif not at % w:
                    held = pix[at - w]
                else:
                    held = predict(pix[at - 1], pix[at - w], pix[at - w - 1])
                e = codes[bits[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
                p += e >> 8
                s = e & 255
                if not e or s > 15:
                    raise ValueError("no such code")
                if s:
                    v = bits[p >> 3] >> (32 - (p & 7) - s) & ((1 << s) - 1)
                    p += s
                    held += v if v >> (s - 1) else v - (1 << s) + 1
                pix[at] = held & 0xFF
            if p > 8 * len(data):
                raise ValueError("frame is cut short")
        return np.frombuffer(bytes(pix), np.uint8).reshape(h, w)

    def _baseline(self) -> np.ndarray:
        alone = len(self.parts) == 1
        hmax, vmax = (1, 1) if alone else (max(p[1] for p in self.parts), max(p[2] for p in self.parts))
        ch, cv = (1, 1) if alone else self.parts[0][1:3]
        mx, my = -(-self.width // (8 * hmax)), -(-self.height // (8 * vmax))
        plan = []
        for i, (cid, h, v, _) in enumerate(self.parts):
            tabs = self.scan[cid]
            plan += [(i, self.codes(0, tabs >> 4), self.codes(1, tabs & 15), i == 0)] * (1 if alone else h * v)
        units, per, segments = mx * my, self.restart or mx * my, self.segments()
        if len(segments) < -(-units // per) or 2 * units * len(plan) > 8 * len(self.entropy):
            raise ValueError("frame is cut short")
        quant, out = self.quant[self.parts[0][3]], np.empty((my * cv * 8, mx * ch * 8), np.uint8)
        for k, data in enumerate(segments[: -(-units // per)]):
            n = min(per, units - k * per)
            where, what = _coefficients(data, plan, n)
            blocks = np.zeros(n * ch * cv * 64)
            blocks[np.frombuffer(where, np.int64)] = np.frombuffer(what, np.int64)
            full = np.zeros((n * ch * cv, 64))
            full[:, ZIGZAG] = blocks.reshape(-1, 64) * quant
            done = np.clip(np.rint(_BASIS.T @ full.reshape(-1, 8, 8) @ _BASIS + 128), 0, 255).astype(np.uint8)
            unit = np.arange(k * per, k * per + n)
            y, x = unit // mx * cv, unit % mx * ch
            tiles = out.reshape(my * cv, 8, mx * ch, 8)
            for by in range(cv):
                for bx in range(ch):
                    tiles[y + by, :, x + bx] = done[by * ch + bx :: ch * cv]
        return out[: self.height, : self.width]


def _coefficients(data: bytes, plan: list[tuple], units: int) -> tuple[array, array]:
    """Places and values of the first component's coefficients that are not zero, in zigzag order,
    64 places a block."""
    bits, p, block = _windows(data), 0, 0
    last = [0] * (1 + max(part for part, *_ in plan))
    where, what = array("q"), array("q")
    for _ in range(units):
        for part, dc, ac, keep in plan:
            e = dc[bits[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
            p += e >> 8
            s = e & 255
            if not e or s > 15:
                raise ValueError("no such code")
            if s:
                v = bits[p >> 3] >> (32 - (p & 7) - s) & ((1 << s) - 1)
                p += s
                last[part] += v if v >> (s - 1) else v - (1 << s) + 1
            if keep:
                where.append(block)
                what.append(last[part])
            z = 1
            while z < 64:
                e = ac[bits[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
                if not e:
                    raise ValueError("no such code")
                p += e >> 8
                s = e & 15
                if s:
                    z += e >> 4 & 15
                    if z > 63:
                        raise ValueError("more coefficients than places")
                    v = bits[p >> 3] >> (32 - (p & 7) - s) & ((1 << s) - 1)
                    p += s
                    if keep:
                        where.append(block + z)
                        what.append(v if v >> (s - 1) else v - (1 << s) + 1)
                    z += 1
                elif e & 0xF0 == 0xF0:
                    z += 16
                else:
                    break
            block += 64 if keep else 0
    if p > 8 * len(data):
        raise ValueError("frame is cut short")
    return where, what


def pictures(avi: Avi, stream: int) -> Iterator[np.ndarray]:
    """Luma samples of a stream's frames, as arrays (frames, height, width) of a bounded number of
    frames in order. Frames that share a header of the uniform kind are decoded together. A frame
    without bytes shows the picture before it; those before the first picture show the first."""
    known: dict[bytes, Jpeg] = {}
    pend: list[bytes] = []
    shape: tuple[int, int] = (0, 0)
    before, early = None, 0

    def flush() -> Iterator[np.ndarray]:
        nonlocal before
        if pend:
            done = _uniform_frames(pend, *shape)
            pend.clear()
            before = done[-1]
            yield done

    for at, size in avi.streams.get(stream, []):
        if not size:
            yield from flush()
            if before is None:
                early += 1
            else:
                yield before[None]
            continue
        raw = avi.data[at : at + size]
        if len(raw) < size:
            raise ValueError("file is cut short")
        scan = raw.find(b"\xff\xda")
        head = raw[: scan + 2 + (raw[scan + 2] << 8 | raw[scan + 3])] if scan > 0 else raw
        jpeg = known.get(head)
        if jpeg is None:
            jpeg = Jpeg(raw)
            if jpeg.uniform and len(known) < 16:
                known[head] = jpeg
        if early and before is None and not pend:
            first = jpeg.luma()
            for _ in range(early):
                yield first[None]
        if not jpeg.uniform:
            yield from flush()
            before = jpeg.luma()
            yield before[None]
            continue
        if (jpeg.height, jpeg.width) != shape or len(pend) >= max(1, min(TOGETHER, (1 << 22) // (jpeg.height * jpeg.width))):
            yield from flush()
            shape = (jpeg.height, jpeg.width)
        end = raw.rfind(b"\xff\xd9")
        pend.append(raw[len(head) : end if end > 0 else len(raw)].replace(b"\xff\0", b"\xff"))
    yield from flush()


def decode_avi(data: bytes, stream: int = 0) -> tuple[Avi, list[np.ndarray]]:
    """The container and all of one stream's frames' luma samples, for files that fit memory."""
    avi = Avi(data)
    return avi, [f for run in pictures(avi, stream) for f in run]


def _uniform_frames(parts: list[bytes], height: int, width: int) -> np.ndarray:
    need = height * width * 9 // 8
    if any(len(p) < need for p in parts):
        raise ValueError("frame is cut short")
    raw = np.frombuffer(b"".join(p[:need] for p in parts), np.uint8)
    diff = _DIFFS[_unpack9(raw)].astype(np.uint8).reshape(len(parts), height, width)  # modulo 256
    diff[:, 0, 0] += np.uint8(128)
    diff[:, :, 0] = np.cumsum(diff[:, :, 0], axis=1, dtype=np.uint8)
    return np.cumsum(diff, axis=2, dtype=np.uint8)


# --- shots ---------------------------------------------------------------------------------------


def histograms(frames: np.ndarray | list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Relative luma histogram of each frame of an array (frames, height, width)."""
    if not len(frames):
        return np.zeros((0, bins))
    frames = np.asarray(frames)
    flat = (frames.reshape(len(frames), -1) >> (8 - bins.bit_length() + 1)).astype(np.int64)
    flat += np.arange(len(frames))[:, None] * bins
    return np.bincount(flat.ravel(), minlength=len(frames) * bins).reshape(len(frames), bins) / max(1, frames[0].size)


def shots(hist: np.ndarray, window: int = WINDOW, spread: float = SPREAD, floor: float = FLOOR) -> list[tuple[int, int, float]]:
    """(first frame, frame after the last, difference at its start) of each shot."""
    n = len(hist)
    if not n:
        return []
    diff = np.zeros(n)
    diff[1:] = np.abs(hist[1:] - hist[:-1]).sum(axis=1) / 2
    sums, squares = np.concatenate([[0], np.cumsum(diff)]), np.concatenate([[0], np.cumsum(diff * diff)])
    cuts, last = [], 0
    for i in np.flatnonzero(diff >= floor).tolist():
        lo = max(last + 1, i - window)  # a cut's own difference says nothing about its shot
        k = i - lo
        mean = (sums[i] - sums[lo]) / k if k else 0.0
        deviation = np.sqrt(max(0.0, (squares[i] - squares[lo]) / k - mean * mean)) if k else 0.0
        if diff[i] > mean + spread * deviation:
            cuts.append(i)
            last = i
    starts = [0, *cuts]
    return [(a, b, float(diff[a])) for a, b in zip(starts, [*cuts, n], strict=True)]


def clips(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Timed clip rows of AVI motion-JPEG media: doc_id, clip, first_frame, n_frames, start_s,
    end_s, cut_difference, mean_luma, stream. Clips are numbered in each video stream.

    Narrow: no shuffle; a task holds one media value, a bounded number of its frames and 17 numbers
    a frame. Null and empty media and files without a picture give no rows; media that cannot be
    read to their end, for whatever damage, give one row with clip -1 and nulls, so that they are not
    lost from sight; null ids and repeated rows pass through; an empty table gives no rows; other
    columns are ignored.
    """

    def found(media: bytes) -> list[tuple]:
        avi, out = Avi(media), []
        for stream in sorted(avi.streams):
            hist, luma, fps = [], [], avi.fps(stream)
            for run in pictures(avi, stream):
                hist.append(histograms(run))
                luma += run.reshape(len(run), -1).mean(axis=1).tolist()
            for k, (a, b, d) in enumerate(shots(np.concatenate(hist) if hist else np.zeros((0, BINS)))):
                out.append((k, a, b - a, a / fps, b / fps, d, float(np.mean(luma[a:b])), stream))
        return out

    def rows(feed: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, media in feed:
            if not media:
                continue
            try:
                clip_rows = found(media)
            except Exception:  # noqa: BLE001  media come from anywhere: whatever fails, the row says so
                clip_rows = [(-1, *[None] * 7)]
            for r in clip_rows:
                yield (doc_id, *r)

    schema = "doc_id long, clip int, first_frame long, n_frames long, start_s double, end_s double, cut_difference double, mean_luma double, stream int"
    return map_rows(df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{media_col}`").cast("binary")), rows, schema)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """AVI media of texts: doc_id, n_bytes, media. Null texts count as empty; a payload is the
    UTF-8 bytes with zeros up to a positive multiple of 64."""

    def rows(feed: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in feed:
            raw = (text or "").encode()
            yield doc_id, len(raw), encode_avi(padded(raw))

    return map_rows(texts(df, id_col, text_col), rows, "doc_id long, n_bytes long, media binary")


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def stored_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as AVI media, read the media back and describe both: doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_clips.

    Media bytes stay in the worker: one narrow pass. Cases as in ``store_texts``; null ids and
    repeated rows pass through; an empty table gives no rows.
    """

    def rows(feed: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in feed:
            raw = (text or "").encode()
            media = encode_avi(padded(raw))
            avi = Avi(media)
            told, hist, left, tail = hashlib.sha256(), [], avi.payload, b""
            for run in pictures(avi, 0):
                hist.append(histograms(run))
                stored = run.tobytes()[:left]
                told.update(stored)
                left, tail = left - len(stored), (tail + stored[-64:])[-64:]
            hist = np.concatenate(hist)
            cut = shots(hist)
            digest = hashlib.sha256(hist.tobytes() + repr(cut).encode()).hexdigest()[:16]
            feature = f"{len(hist)} frames, {len(cut)} clips, {digest}"
            yield doc_id, len(raw), avi.payload - left, told.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, len(cut)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips long"
    return map_rows(texts(df, id_col, text_col), rows, schema)


def op2_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_features(table(spark, sf_dir, "documents"))
