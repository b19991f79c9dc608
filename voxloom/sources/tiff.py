"""Multi-page 8-bit TIFF volumes as a Spark data source.

``register(spark)`` adds the format ``voxel_tiff``: one row for each page; a file is one partition, a file
above ``split_bytes`` one for each run of pages of that size. Options: ``samples`` (any, strict for 0 and 255,
roi for 0, 1 and 255), ``threshold``, ``split_bytes``. Pages are read one by one, so a file may be larger than
memory and than the 2 GiB of a binary column. The bytes can also come from ``binaryFile`` rows
(``decode``), which reach stores that only Spark reads.

Read are files and BigTIFF files of either byte order, in strips or tiles; plain, LZW, deflate and PackBits;
with or without horizontal differencing; white or black as zero. Whatever else would change samples is an
error: other bit depths, signed or floating samples, several samples a pixel, reversed bits, other predictors
and compressions.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxloom.sources.spacing import RESOLUTION_UNIT_UM, UNITS_UM

#: TIFF tag numbers and value sizes; fixed values of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, DESCRIPTION, STRIPS, SAMPLES, ROWS, COUNTS, XRES, YRES, RESUNIT = 256, 257, 258, 259, 262, 266, 270, 273, 277, 278, 279, 282, 283, 296
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Tags that are read; all others are passed over unread.
_USED = {WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, DESCRIPTION, STRIPS, SAMPLES, ROWS, COUNTS, XRES, YRES, RESUNIT, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS, SAMPLE_FORMAT}
DOMAINS = {"any": None, "strict": {0, 255}, "roi": {0, 1, 255}}
SCHEMA = "path string, z int, width int, height int, x_um double, y_um double, z_um double, voxels binary"


class TiffError(ValueError):
    pass


class Bytes:
    """Bytes by position, of a file's content or of an open file that can seek."""

    def __init__(self, held: bytes | None = None, file=None):
        self.held, self.file = held, file

    def at(self, start: int, n: int) -> bytes:
        if self.held is not None:
            found = self.held[start : start + n]
        else:
            self.file.seek(start)
            found = self.file.read(n)
        if len(found) < n:
            raise TiffError("the file ends too early")
        return found


class Layout:
    """Byte order and field sizes of a file: 32-bit, or 64-bit for BigTIFF."""

    def __init__(self, source: Bytes):
        head = source.at(0, 8)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2], "")
        version = struct.unpack(self.order + "H", head[2:4])[0] if self.order else 0
        if version == 42:
            self.word, self.count, self.first = "I", "H", struct.unpack(self.order + "I", head[4:8])[0]
        elif version == 43 and struct.unpack(self.order + "HH", head[4:8]) == (8, 0):
            self.word, self.count, self.first = "Q", "Q", struct.unpack(self.order + "Q", source.at(8, 8))[0]
        else:
            raise TiffError("not a TIFF file")
        self.word_size, self.count_size = struct.calcsize(self.word), struct.calcsize(self.count)
        self.entry_size = 4 + 2 * self.word_size

    def entries(self, source: Bytes, at: int) -> tuple[int, int]:
        """Where the entries of the directory at a position begin, and how many they are."""
        return at + self.count_size, struct.unpack(self.order + self.count, source.at(at, self.count_size))[0]

    def links(self, source: Bytes) -> Iterator[int]:
        """Positions of all directories, one a page."""
        at, seen = self.first, set()
        while at:
            if at in seen:
                raise TiffError("pages form a cycle")
            seen.add(at)
            yield at
            start, n = self.entries(source, at)
            at = struct.unpack(self.order + self.word, source.at(start + n * self.entry_size, self.word_size))[0]

    def tags(self, source: Bytes, at: int) -> dict[int, list]:
        """Tags of the directory at a position."""
        start, n = self.entries(source, at)
        raw = source.at(start, n * self.entry_size)
        found = {}
        for k in range(0, len(raw), self.entry_size):
            tag, kind, count = struct.unpack(f"{self.order}HH{self.word}", raw[k : k + 4 + self.word_size])
            if tag in _USED:
                found[tag] = self.values(source, kind, count, raw[k + 4 + self.word_size : k + self.entry_size])
        return found

    def values(self, source: Bytes, kind: int, count: int, field: bytes) -> list:
        size = _SIZES.get(kind, 1) * count
        raw = field[:size] if size <= self.word_size else source.at(struct.unpack(self.order + self.word, field)[0], size)
        if kind == 2:
            return [raw.split(b"\0")[0].decode("utf-8", "replace")]
        if kind in (5, 10):
            n = struct.unpack(f"{self.order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
            return [a / b if b else 0.0 for a, b in zip(n[::2], n[1::2], strict=True)]
        if kind not in _CODES:
            raise TiffError(f"unknown field type {kind}")
        return list(struct.unpack(f"{self.order}{count}{_CODES[kind]}", raw))


def pages(data: bytes) -> Iterator[dict[int, list]]:
    """Tags of each page."""
    source = Bytes(data)
    layout = Layout(source)
    return (layout.tags(source, at) for at in layout.links(source))


def _unpack_bits(raw: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw) and len(out) < size:
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += raw[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


#: LZW codes; fixed values of the format.
CLEAR, END, WIDEST = 256, 257, 12


def _lzw(raw: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first; a code grows one entry early, as the format has it."""
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    known, width, last = list(single), 9, b""
    out = bytearray()
    held = bits = 0
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == END or len(out) >= size:
            break
        if code == CLEAR:
            known, width, last = list(single), 9, b""
            continue
        if code < len(known):
            word = known[code]
        elif code == len(known) and last:
            word = last + last[:1]
        else:
            raise TiffError("damaged LZW codes")
        out += word
        if last:
            if len(known) == 1 << WIDEST:
                raise TiffError("damaged LZW codes")
            known.append(last + word[:1])
            if len(known) == (1 << width) - 1 and width < WIDEST:
                width += 1
        last = word
    return bytes(out)


def _inflate(raw: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(raw, size) if size else b""


_DECODERS = {1: lambda raw, size: raw, 5: _lzw, 8: _inflate, 32946: _inflate, 32773: _unpack_bits}


def samples(source: Bytes, tags: dict[int, list]) -> np.ndarray:
    """The samples of a page. Strips are tiles as wide as the page; those at its edges may be cut."""
    one = lambda tag, default: tags.get(tag, [default])[0]
    w, h = tags[WIDTH][0], tags[HEIGHT][0]
    if one(BITS, 1) != 8 or one(SAMPLES, 1) != 1 or one(SAMPLE_FORMAT, 1) != 1 or one(PHOTOMETRIC, 1) not in (0, 1):
        raise TiffError("pages must be 8-bit gray")
    if one(FILL_ORDER, 1) != 1:
        raise TiffError("reversed bits are not supported")
    decode, predictor = _DECODERS.get(one(COMPRESSION, 1)), one(PREDICTOR, 1)
    if decode is None:
        raise TiffError(f"compression {one(COMPRESSION, 1)} is not supported")
    if predictor not in (1, 2):
        raise TiffError(f"predictor {predictor} is not supported")
    tiled = TILES in tags
    tw, th = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (w, min(one(ROWS, h), h))
    starts, counts = (tags[TILES], tags[TILE_COUNTS]) if tiled else (tags[STRIPS], tags[COUNTS])
    if min(w, h, tw, th) < 1 or tw > 1 << 24 or th > 1 << 24:
        raise TiffError("sides must be positive")
    across = -(-w // tw)
    if len(starts) != across * -(-h // th) or len(counts) != len(starts):
        raise TiffError("strips or tiles do not cover the page")
    page = np.empty((h, w), np.uint8)
    for k, (start, n) in enumerate(zip(starts, counts, strict=True)):
        y, x = k // across * th, k % across * tw
        rows = th if tiled else min(th, h - y)
        raw = decode(source.at(start, n), rows * tw)
        if len(raw) < rows * tw:
            raise TiffError("a strip or tile is too short")
        part = np.frombuffer(raw, np.uint8, rows * tw).reshape(rows, tw)
        if predictor == 2:
            part = np.add.accumulate(part, axis=1, dtype=np.uint8)
        page[y : y + rows, x : x + tw] = part[: h - y, : w - x]
    return 255 - page if one(PHOTOMETRIC, 1) == 0 else page


def description_value(text: str, key: str) -> str | None:
    for line in text.splitlines():
        name, eq, value = line.partition("=")
        if eq and name.strip() == key:
            return value.strip()
    return None


def spacing_um(tags: dict[int, list]) -> tuple[float | None, float | None, float | None]:
    """Calibration of a page: x and y from the resolution, z from the description."""
    text = tags.get(DESCRIPTION, [""])[0]
    named = UNITS_UM.get((description_value(text, "unit") or "").lower())
    unit = RESOLUTION_UNIT_UM.get(tags.get(RESUNIT, [1])[0], named)
    side = lambda t: unit / tags[t][0] if unit and tags.get(t) and tags[t][0] > 0 else None
    try:
        z = float(description_value(text, "spacing") or "") * (named or 1.0)
    except ValueError:
        z = None
    return side(XRES), side(YRES), z


def isotropic(x: float | None, y: float | None, z: float | None) -> float:
    if x is None or y is None or z is None:
        raise TiffError("spacing is not given in all directions")
    if min(x, y, z) <= 0 or abs(x - y) / max(x, y) > 0.01:
        raise TiffError("x and y spacing differ")
    if (max(x, y, z) - min(x, y, z)) / max(x, y, z) > 1e-6:
        raise TiffError("spacing is not isotropic")
    return x


def read_pages(data: bytes, threshold: int = 0, domain: str = "any") -> Iterator[tuple]:
    """(z, width, height, x_um, y_um, z_um, packed voxels) of each page; value > threshold is set."""
    source = Bytes(data)
    layout = Layout(source)
    shape, z = None, -1
    for z, row in enumerate(_read(source, layout, layout.links(source), 0, threshold, domain)):  # noqa: B007
        shape = row[1:3]
        yield row
    if shape is None or min(*shape, z + 1) < 2:
        raise TiffError("every side needs two voxels")


def _read(source: Bytes, layout: Layout, links: Iterator[int] | list[int], first: int, threshold: int, domain: str) -> Iterator[tuple]:
    shape, allowed = None, DOMAINS[domain]
    for z, at in enumerate(links, first):
        tags = layout.tags(source, at)
        v = samples(source, tags)
        shape = shape or v.shape
        if v.shape != shape:
            raise TiffError("pages differ in size")
        if allowed is not None and (odd := set(np.flatnonzero(np.bincount(v.reshape(-1), minlength=256)).tolist()) - allowed):
            raise TiffError(f"samples outside {sorted(allowed)}: {sorted(odd)[:3]}")
        yield (z, shape[1], shape[0], *spacing_um(tags), np.packbits(v > threshold).tobytes())


#: What damaged bytes raise.
_DAMAGE = (struct.error, zlib.error, ValueError, KeyError, IndexError, OverflowError, MemoryError)


def read_volume(data: bytes, threshold: int = 0, domain: str = "any") -> tuple:
    """(width, height, depth, x_um, y_um, z_um, packed voxels) of a whole file, spacing from its first
    page. Whatever is wrong with the bytes is a TiffError."""
    try:
        found = list(read_pages(data, threshold, domain))
    except TiffError:
        raise
    except _DAMAGE as why:
        raise TiffError(f"damaged file: {why!r}") from why
    _, w, h, *um, _ = found[0]
    if w * h % 8 == 0:
        return w, h, len(found), *um, b"".join(f[6] for f in found)
    bits = [np.unpackbits(np.frombuffer(f[6], np.uint8), count=w * h) for f in found]
    return w, h, len(found), *um, np.packbits(np.concatenate(bits)).tobytes()


def write(volume: np.ndarray, h_um: float | None = None) -> bytes:
    """A TIFF file of a mask, one strip a page, with calibration."""
    text = b"ImageJ=1.53\nunit=um\nspacing=%r\n\0" % h_um if h_um else b"\0"
    out = bytearray(b"II*\0" + b"\0" * 4)
    link = 4
    for page in volume:
        raw = (page.astype(np.uint8) * 255).tobytes()
        at = len(out)
        out += raw
        text_at = len(out)
        out += text + b"\0" * (len(text) % 2)
        res_at = len(out)
        out += struct.pack("<4I", 1_000_000, round(1_000_000 * (h_um or 1)), 1_000_000, round(1_000_000 * (h_um or 1)))
        entries = [(WIDTH, 3, 1, page.shape[1]), (HEIGHT, 3, 1, page.shape[0]), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, 1), (PHOTOMETRIC, 3, 1, 1), (DESCRIPTION, 2, len(text), text_at), (STRIPS, 4, 1, at), (SAMPLES, 3, 1, 1), (ROWS, 3, 1, page.shape[0]), (COUNTS, 4, 1, len(raw)), (XRES, 5, 1, res_at), (YRES, 5, 1, res_at + 8), (RESUNIT, 3, 1, 1)]
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(entries))
        for tag, kind, n, value in entries:
            out += struct.pack("<HHII", tag, kind, n, value)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


class _Pages(InputPartition):
    """Some pages of a file: the positions of their directories, or None for all."""

    def __init__(self, path: str, links: list[int] | None, first: int):
        self.path, self.links, self.first = path, links, first


#: Bytes of a file's pages that one task reads; a larger file is dealt out.
SPLIT_BYTES = 256 << 20


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def _fs(self, path: str):
        from pyarrow import fs as pafs

        return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)

    def partitions(self) -> list[_Pages]:
        from pyarrow import fs as pafs

        found = []
        split = int(self.options.get("split_bytes", SPLIT_BYTES))
        for path in json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]:
            fs, root = self._fs(path)
            info = fs.get_file_info(root)
            files = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
            for f in sorted(files, key=lambda f: f.path):
                if not f.is_file or not f.path.lower().endswith((".tif", ".tiff")):
                    continue
                if f.size <= split:
                    found.append(_Pages(f.path, None, 0))
                    continue
                try:
                    with fs.open_input_file(f.path) as file:
                        source = Bytes(file=file)
                        links = list(Layout(source).links(source))
                except TiffError:
                    found.append(_Pages(f.path, None, 0))  # the task that reads it says what is wrong
                    continue
                step = max(1, len(links) * split // f.size)
                found += [_Pages(f.path, links[k : k + step], k) for k in range(0, len(links), step)]
        return found

    def read(self, partition: _Pages) -> Iterator[tuple]:
        fs = self._fs(json.loads(self.options["paths"])[0] if "paths" in self.options else self.options["path"])[0]
        threshold, domain, guarded = int(self.options.get("threshold", 0)), self.options.get("samples", "any"), "guarded" in self.options
        tail = (None,) if guarded else ()
        try:
            with fs.open_input_file(partition.path) as file:
                source = Bytes(file=file)
                layout = Layout(source)
                links = layout.links(source) if partition.links is None else partition.links
                for row in _read(source, layout, links, partition.first, threshold, domain):
                    yield (partition.path, *row, *tail)
        except (TiffError, *_DAMAGE) as why:
            if not guarded:
                raise
            yield (partition.path, *[None] * 7, str(why) if isinstance(why, TiffError) else f"damaged file: {why!r}")


class VoxelTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voxel_tiff"

    def schema(self) -> str:
        return SCHEMA + (", problem string" if "guarded" in self.options else "")

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VoxelTiff)


def discover(spark: SparkSession, folder: str, subdirs: tuple[str, ...] = ()) -> DataFrame:
    """TIFF files below a folder, or below some of its subfolders, with their bytes; ordered by
    path where they are listed, not here: order is no property of a distributed table. Spark's file
    index leaves out files of length 0."""
    roots = [f"{folder.rstrip('/')}/{s}" for s in subdirs] or [folder]
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][iI][fF]*").load(roots).filter(F.lower("path").rlike(r"\.tiff?$"))


def decode(files: DataFrame, threshold: int = 0, domain: str = "any") -> DataFrame:
    """Pages of binaryFile rows, as the data source gives them."""

    target = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = [(path, *r) for r in read_pages(content.as_py(), threshold, domain)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), target.types, strict=True)], schema=target)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


VOLUMES = "path string, width int, height int, depth int, x_um double, y_um double, z_um double, voxels binary, problem string"
#: Files above this size do not fit into a binary column and are read page by page.
LARGEST = (1 << 31) - 1


def volumes(spark: SparkSession, files: DataFrame, threshold: int = 0, domain: str = "any", largest: int = LARGEST, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row for each file of ``discover``: its volume, packed, or its problem. Files up to ``largest`` bytes
    are decoded where Spark reads them; the pages of larger ones are read apart and put together, and
    only their packed voxels (an eighth of a byte each) are moved."""
    small = decode_volumes(files.filter(F.col("length") <= largest), threshold, domain)
    large = [r["path"] for r in files.filter(F.col("length") > largest).select("path").collect()]
    if not large:
        return small
    register(spark)
    found = spark.read.format("voxel_tiff").options(paths=json.dumps(large), threshold=threshold, samples=domain, split_bytes=split_bytes, guarded=True).load()
    # the reader's paths have no scheme; those of ``files`` do
    names = spark.createDataFrame([(p, _bare(p)) for p in large], "path string, bare string")
    return small.unionByName(join_pages(found).withColumnRenamed("path", "bare").join(F.broadcast(names), "bare").select(*small.columns))


def _bare(path: str) -> str:
    return _Reader({})._fs(path)[1]


def join_pages(found: DataFrame) -> DataFrame:
    """Volumes of guarded page rows. A page's problem is its file's; pages must be 0, 1, 2 ... of one size."""
    target = to_arrow_schema(StructType.fromDDL(VOLUMES))
    held = found.groupBy("path").agg(F.max("problem").alias("problem"), F.sort_array(F.collect_list(F.struct("z", "width", "height", "x_um", "y_um", "z_um", "voxels"))).alias("pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, problem, pages_ in zip(*b.columns, strict=True):
                row = _joined(problem.as_py(), pages_.values) if pages_.values is not None else (*[None] * 7, "no pages")
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((path.as_py(), *row), target.types, strict=True)], schema=target)

    return held.mapInArrow(run, VOLUMES)


def _joined(problem: str | None, found: pa.StructArray) -> tuple:
    z, w, h = (found.field(k).to_pylist() for k in range(3))
    if problem is None and (z != list(range(len(z))) or len(set(zip(w, h, strict=True))) != 1):
        problem = "pages differ in size"
    if problem is None and min(w[0], h[0], len(z)) < 2:
        problem = "every side needs two voxels"
    if problem is not None:
        return (*[None] * 7, problem)
    n = w[0] * h[0]
    um = [found.field(k)[0].as_py() for k in (3, 4, 5)]
    parts = (v.as_buffer() for v in found.field(6))
    if n % 8 == 0:
        return w[0], h[0], len(z), *um, b"".join(parts), None
    # pages end inside a byte: bits of eight pages at a time make whole bytes
    out, kept = [], []
    for part in parts:
        kept.append(np.unpackbits(np.frombuffer(part, np.uint8), count=n))
        if len(kept) == 8:
            out.append(np.packbits(np.concatenate(kept)).tobytes())
            kept = []
    return w[0], h[0], len(z), *um, b"".join(out) + (np.packbits(np.concatenate(kept)).tobytes() if kept else b""), None


def decode_volumes(files: DataFrame, threshold: int = 0, domain: str = "any") -> DataFrame:
    """One row for each binaryFile row: its volume, packed, or the problem that keeps it from being
    read. Narrow; a task holds one file."""
    target = to_arrow_schema(StructType.fromDDL(VOLUMES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    row = (path, *read_volume(content.as_py(), threshold, domain), None)
                except TiffError as why:
                    row = (path, *[None] * 7, str(why))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, target.types, strict=True)], schema=target)

    return files.select("path", "content").mapInArrow(run, VOLUMES)
