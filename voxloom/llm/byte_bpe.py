"""Byte-level BPE by two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary's byte strings: one probe tells whether a
whole pre-token is a token. A pre-token that is not goes to tier two, merges over a linked list
of its bytes that a heap of pair ranks drives, in O(n log n). Both tiers stand behind a bounded
memo for each worker, since pre-tokens repeat.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.base import CACHES, map_rows, table, texts
from voxloom.llm.wordbpe import Memo

# The split pattern of the vocabulary in its parts, with white space spelled out
# as Unicode defines it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHOLE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_L = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017e"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_ASCII = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[a-zA-Z]+| ?[0-9]+| ?[^\t-\r a-zA-Z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_BEYOND = re.compile("[^\0-\u017e]")


def pre_tokens(text: str) -> list[str]:
    if text.isascii():
        return _ASCII.findall(text)
    return (_WHOLE if _BEYOND.search(text) else _LATIN).findall(text)


class PerfectHash:
    """Minimal perfect hash: n byte strings onto 0..n-1 (hash, displace; lone keys get a slot)."""

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        m = self.m = n // 3 + 1
        groups: list[list[tuple[int, bytes]]] = [[] for _ in range(m)]
        for k in keys:
            h = xxhash.xxh3_128_intdigest(k)
            groups[(h & 0xFFFFFFFF) % m].append((h >> 32, k))
        self.shift = array("q", bytes(8 * m))
        self.slots: list[bytes | None] = [None] * n
        order = sorted(range(m), key=lambda g: -len(groups[g]))
        free, at = iter(range(n)), 0
        for g in order:
            group = groups[g]
            if not group:
                break
            if len(group) == 1:
                while self.slots[at := next(free)] is not None:
                    pass
                self.shift[g] = -at - 1
                self.slots[at] = group[0][1]
                continue
            d = 0
            while True:
                to = [self._slot(h, d) for h, _ in group]
                if len(set(to)) == len(to) and all(self.slots[s] is None for s in to):
                    break
                d += 1
            self.shift[g] = d
            for s, (_, k) in zip(to, group, strict=True):
                self.slots[s] = k

    def _slot(self, h: int, d: int) -> int:
        x = ((h & 0xFFFFFFFFFFFFFFFF) + d * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        return (x ^ x >> 32) * 0xC2B2AE3D27D4EB4F % (1 << 64) // (1 << 20) % self.n

    def find(self, key: bytes) -> int:
        """The key's slot, or -1 where it is no member."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(h & 0xFFFFFFFF) % self.m]
        s = -d - 1 if d < 0 else self._slot(h >> 32, d)
        return s if self.slots[s] == key else -1


class _Strings(dict):
    """Byte strings by id; ids that are in no vocabulary read as the replacement character."""

    def __missing__(self, key: int) -> bytes:
        return b"\xef\xbf\xbd"


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.hash = PerfectHash(list(ranks))
        self.ids = array("q", (ranks[k] if k is not None else -1 for k in self.hash.slots))
        self.strings = _Strings((i, k) for k, i in ranks.items())
        self.packed = Memo(lambda p: array("I", self.encode_piece(p.encode())).tobytes())

    def rank(self, part: bytes) -> int:
        s = self.hash.find(part)
        return -1 if s < 0 else self.ids[s]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank(piece)
        return [whole] if whole >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is in the vocabulary."""
        n, rank = len(piece), self.ranks.get
        ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := rank(piece[i : ends[j]])) is not None:
                heapq.heappush(heap, (r, i, ends[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or ends[j] != end:
                continue  # one side has been merged since
            ends[i], after[i], alive[j] = end, after[j], False
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, pre_tokens(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.strings.__getitem__, array("I", ids[: len(ids) // 4 * 4])))


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    with open(path, "rb") as f:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


CACHES["byte_bpe"] = load.cache_clear


def encode_documents(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode texts: doc_id, ids (little-endian unsigned 32-bit integers as binary).

    Null and empty texts give empty ids; null ids, repeated rows and empty tables pass through;
    other columns are ignored. Narrow: no shuffle.
    """

    def rows(feed: Iterator[tuple]) -> Iterator[tuple]:
        bpe = load(ranks_path)
        for doc_id, text in feed:
            yield doc_id, bpe.encode(text or "")

    return map_rows(texts(df, id_col, text_col), rows, "doc_id long, ids binary", keep="byte_bpe")


def decode_documents(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode ids of ``encode_documents``: doc_id, bytes (binary; null and empty ids give empty
    bytes). An id that is not in the vocabulary gives the three bytes of U+FFFD; up to three bytes
    behind the last whole id are ignored; null ids of documents, repeated rows and empty tables
    pass through; other columns are ignored."""

    def rows(feed: Iterator[tuple]) -> Iterator[tuple]:
        bpe = load(ranks_path)
        for doc_id, ids in feed:
            yield doc_id, bpe.decode(ids or b"")

    return map_rows(df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{ids_col}`").cast("binary")), rows, "doc_id long, bytes binary", keep="byte_bpe")


def round_trip(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids do not leave the worker, so one narrow pass over the scan does both. Cases as in
    ``encode_documents``.
    """

    def rows(feed: Iterator[tuple]) -> Iterator[tuple]:
        bpe = load(ranks_path)
        for doc_id, text in feed:
            ids = bpe.encode(text or "")
            yield doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return map_rows(texts(df, id_col, text_col), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keep="byte_bpe")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
