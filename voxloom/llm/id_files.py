"""Token-id files of patched frame-of-reference blocks.

A shard file holds the ids of documents in ascending order. Ids are cut into blocks of 128. Each
block subtracts its minimum and packs the differences at the width that a percentile of them
needs; the high bits of the few that need more go to an exception list. Layout, little-endian:

    "VXPF" | version u32 | blocks... | block starts u64[n_blocks] | widths u8[n_blocks]
    | documents: doc_id i64[n] , has_id u8[n], n_tokens u64[n] | footer

    block: minimum u32 | count u16 | exceptions u16 | packed bits (16 bytes for each bit of width)
           | positions u8[exceptions] | high parts u32[exceptions]
    footer: n_ids u64 | n_blocks u64 | n_docs u64 | index at u64 | crc32 of the index u32 | "VXPF"

The block index gives random access: ``read_range`` decodes only the blocks a range touches.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import wordbpe
from voxloom.llm.base import map_rows, shared_dir, split_ranges, table, texts

BLOCK = 128
PERCENTILE = 0.9
END_ID = 1
#: A shard file is closed after the document that brings it to so many ids (about 30 MB packed).
SHARD_IDS = 1 << 24
MAGIC = b"VXPF"
_HEAD = struct.Struct("<IHH")
_FOOT = struct.Struct("<QQQQI4s")


def _bit_width(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)  # 0 for 0; exact below 2**53


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[list[bytes], np.ndarray]:
    """Blocks of an id array (unsigned 32-bit), and their widths."""
    n = len(ids)
    nb = -(-n // BLOCK)
    if not nb:
        return [], np.zeros(0, np.uint8)
    full = np.empty(nb * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = ids[-1]
    full = full.reshape(nb, BLOCK)
    low = full.min(axis=1)
    diff = full - low[:, None]
    rank = min(BLOCK - 1, int(percentile * (BLOCK - 1)))
    width = _bit_width(np.partition(diff, rank, axis=1)[:, rank])
    out: list[bytes] = [b""] * nb
    counts = np.full(nb, BLOCK)
    counts[-1] = n - (nb - 1) * BLOCK
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        part = diff[at]
        high = part >> np.uint32(w) if w < 32 else np.zeros_like(part)
        if w:
            lanes = 16 if w <= 16 else 32
            kept = (part & np.uint32((1 << int(w)) - 1)).astype(f"<u{lanes // 8}")
            bits = np.unpackbits(kept.view(np.uint8).reshape(len(at), BLOCK, lanes // 8), axis=2, bitorder="little")[:, :, :w]
            packed = np.packbits(np.ascontiguousarray(bits).reshape(len(at), -1), axis=1, bitorder="little")
        row, col = np.nonzero(high)
        starts = np.searchsorted(row, np.arange(len(at) + 1))
        high_of, col8 = high[row, col].astype("<u4"), col.astype(np.uint8)
        for k, b in enumerate(at):
            s, e = starts[k], starts[k + 1]
            out[b] = _HEAD.pack(int(low[b]), int(counts[b]), e - s) + (packed[k].tobytes() if w else b"") + col8[s:e].tobytes() + high_of[s:e].tobytes()
    return out, width.astype(np.uint8)


def decode_blocks(data: bytes, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Ids of the blocks at ``starts``."""
    nb = len(starts)
    if not nb:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    starts = starts.astype(np.int64)
    heads = raw[starts[:, None] + np.arange(8)]
    low = heads[:, :4].copy().view("<u4")[:, 0]
    counts, n_exc = heads[:, 4:6].copy().view("<u2")[:, 0].astype(np.int64), heads[:, 6:8].copy().view("<u2")[:, 0].astype(np.int64)
    diff = np.zeros((nb, BLOCK), np.uint32)
    for w in np.unique(widths):
        if not w:
            continue
        w = int(w)
        at = np.flatnonzero(widths == w)
        lanes = 16 if w <= 16 else 32
        bits = np.unpackbits(raw[starts[at][:, None] + 8 + np.arange(16 * w)], axis=1, bitorder="little").reshape(len(at), BLOCK, w)
        wide = np.zeros((len(at), BLOCK, lanes), np.uint8)
        wide[:, :, :w] = bits
        diff[at] = np.packbits(wide, axis=2, bitorder="little").view(f"<u{lanes // 8}")[:, :, 0]
    total = int(n_exc.sum())
    if total:
        block = np.repeat(np.arange(nb), n_exc)
        k = np.arange(total) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
        base = starts + 8 + 16 * widths.astype(np.int64)
        pos = raw[base[block] + k]
        high = raw[(base + n_exc)[block][:, None] + 4 * k[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        diff[block, pos] |= high << widths[block].astype(np.uint32)
    full = diff + low[:, None]
    if counts[-1] == BLOCK:
        return full.reshape(-1)
    return full.reshape(-1)[: (nb - 1) * BLOCK + counts[-1]]


class ShardWriter:
    """Streams documents to one shard file; memory holds the ids of ``flush`` blocks at most."""

    def __init__(self, out, flush: int = 8192):
        self.out, self.flush = out, flush
        self.at = out.write(MAGIC + struct.pack("<I", 1)) or 8
        self.at = 8
        self.pending: list[bytes] = []
        self.held = 0
        self.starts: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int]] = []
        self.n_ids = self.n_added = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.n_added += len(ids) // 4
        self.pending.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.flush * BLOCK:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        keep = 0 if last else len(ids) % BLOCK
        done = ids[: len(ids) - keep]
        blocks, widths = encode_blocks(done)
        sizes = np.fromiter(map(len, blocks), np.int64, len(blocks))
        self.starts.append(self.at + np.cumsum(sizes) - sizes)
        self.widths.append(widths)
        self.out.write(b"".join(blocks))
        self.at += int(sizes.sum())
        self.n_ids += len(done)
        self.pending, self.held = [ids[len(ids) - keep :].tobytes()], keep

    def close(self) -> tuple[int, int]:
        self._blocks(True)
        starts = np.concatenate(self.starts).astype("<u8")
        widths = np.concatenate(self.widths)
        ids = np.array([d or 0 for d, _ in self.docs], "<i8")
        has = np.array([d is not None for d, _ in self.docs], np.uint8)
        counts = np.array([n for _, n in self.docs], "<u8")
        index = starts.tobytes() + widths.tobytes() + ids.tobytes() + has.tobytes() + counts.tobytes()
        self.out.write(index + _FOOT.pack(self.n_ids, len(starts), len(self.docs), self.at, zlib.crc32(index), MAGIC))
        return len(self.docs), self.n_ids


class Shard:
    """Reads a shard file's bytes."""

    def __init__(self, data: bytes):
        self.data = data
        self.n_ids, nb, nd, at, crc, magic = _FOOT.unpack_from(data, len(data) - _FOOT.size)
        index = data[at : len(data) - _FOOT.size]
        if data[:4] != MAGIC or magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError("not a whole shard file")
        self.starts = np.frombuffer(index, "<u8", nb)
        self.widths = np.frombuffer(index, np.uint8, nb, 8 * nb)
        rest = 9 * nb
        self.doc_ids = np.frombuffer(index, "<i8", nd, rest)
        self.has_id = np.frombuffer(index, np.uint8, nd, rest + 8 * nd)
        self.counts = np.frombuffer(index, "<u8", nd, rest + 9 * nd).astype(np.int64)

    def read_range(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1 of the shard, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        ids = decode_blocks(self.data, self.starts[first:last], self.widths[first:last])
        return ids[start - first * BLOCK : stop - first * BLOCK]

    def documents(self, chunk: int = 1 << 20) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in the shard, its ids as bytes), in order; decodes about
        ``chunk`` ids at a time."""
        ends = np.cumsum(self.counts)
        starts = ends - self.counts
        at, n = 0, len(ends)
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + chunk, "right")))
            base = int(starts[at])
            ids = self.read_range(base, int(ends[to - 1])).astype("<u4")
            for i in range(at, to):
                yield int(self.doc_ids[i]) if self.has_id[i] else None, int(starts[i]), ids[starts[i] - base : ends[i] - base].tobytes()
            at = to


def write_id_files(df: DataFrame, tokenizer_path: str, out_dir: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> list[tuple[str, int, int]]:
    """Write ids of all documents, each with ``end_id`` behind it, to shard files in ascending
    doc_id order; returns (path, documents, ids) of each shard in order.

    Texts are shuffled once, by ranges of doc_id; a range streams to its files, and a file is closed
    after the document that brings it to ``shard_ids`` ids, so a reader's memory does not grow with
    the input. A file gets its name when it is whole, so a repeated or lost task
    leaves no half shard. Null ids come first; rows of one id are ordered by text, and where an id (or
    null) fills more than a range by a hash of the text first. Null and empty texts have the end id
    only, an empty table gives no shard. Only one row for each shard comes to the driver.
    """
    rows = texts(df, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = split_ranges(rows, "key", 4 * parts)

    def write(feed: Iterator[tuple]) -> Iterator[tuple]:
        from pyarrow import fs as pafs

        fs, folder = pafs.FileSystem.from_uri(out_dir)
        bpe, tail = wordbpe.load(tokenizer_path), int(end_id).to_bytes(4, "little")
        shard = writer = sink = temp = None
        part = 0

        def done() -> tuple:
            n_docs, n_ids = writer.close()
            sink.close()
            name = f"{folder}/shard-{shard:08d}-{part:06d}.vxpf"
            fs.move(temp, name)
            return shard, part, name, n_docs, n_ids

        for bucket, doc_id, text in feed:
            if writer and (bucket != shard or writer.n_added >= shard_ids):
                yield done()
                writer = None
                part += 1
            if not writer:
                shard, part = bucket, part if bucket == shard else 0
                temp = f"{folder}/.part-{bucket:08d}-{uuid.uuid4().hex}"
                sink = fs.open_output_stream(temp)
                writer = ShardWriter(sink)
            writer.add(doc_id, bpe.ids(text or "") + tail)
        if writer:
            yield done()

    from pyarrow import fs as pafs

    fs, folder = pafs.FileSystem.from_uri(out_dir)
    fs.create_dir(folder, recursive=True)
    placed = rows.withColumn("hash", ranges.hash(F.col("key"), F.col("text"))).withColumn("bucket", ranges.number(F.col("key"), F.col("hash")))
    dealt = placed.repartition(parts, "bucket").sortWithinPartitions("bucket", "key", "hash", "text").select("bucket", "doc_id", "text")
    found = map_rows(dealt, write, "shard int, part int, path string, n_docs long, n_ids long", keep="wordbpe").collect()
    return [(r["path"], r["n_docs"], r["n_ids"]) for r in sorted(found, key=lambda r: (r["shard"], r["part"]))]


def read_id_files(spark: SparkSession, shards: list[tuple[str, int, int]], out_dir: str, digests: bool = False) -> DataFrame:
    """Documents of shard files: doc_id, start (ids of all documents before it), n_tokens, and ids
    (binary) or, with ``digests``, ids_crc32 (their crc32). A task holds one shard at a time."""
    before, starts = 0, {}
    for path, _, n in shards:
        starts[path.rpartition("/")[2]] = before
        before += n
    held = spark.sparkContext.broadcast(starts)  # one number for each shard
    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids binary")

    def rows(feed: Iterator[tuple]) -> Iterator[tuple]:
        for path, data in feed:
            base = held.value[path.rpartition("/")[2]]
            for doc_id, start, ids in Shard(data).documents():
                yield doc_id, base + start, len(ids) // 4, zlib.crc32(ids) if digests else ids

    if not shards:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.vxpf").load(out_dir).select("path", "content")
    return map_rows(files, rows, schema)


def read_digests(spark: SparkSession, shards: list[tuple[str, int, int]], out_dir: str) -> DataFrame:
    return read_id_files(spark, shards, out_dir, digests=True)


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out_dir = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    shards = write_id_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out_dir)
    return read_id_files(spark, shards, out_dir, digests=True)
