"""Hierarchical multi-length packing.

Documents are cut into full windows of the longest tier; what is left of each goes to the tier of
the smallest context size that holds it. Tiers are packed from the longest down: a window takes
one of its tier's pieces, its gap is filled with whole pieces of shorter tiers, largest that fits
first, and what still gapes with the front of one more piece, whose rest is routed anew. So every
window is full at its tier's size, a power of two, and needs no padding. Only the last sequence of
a partition, of under the smallest tier, is padded. Sequences are dealt to step groups so that
each step sees alike numbers of tokens of each tier and alike attention cost.

All of it is one narrow pass: a partition packs groups of bounded token count one after another
and carries the unfinished rest to the next group.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import wordbpe
from voxloom.llm.base import map_rows, table, texts

TIERS = (512, 1024, 2048, 4096)
GROUP_TOKENS = 1 << 20
STEP_TOKENS = 1 << 18
END_ID = 2

Piece = tuple[int, int, int]  # document number in the group, start, length


class Packer:
    """Packs pieces of the documents given to it; ``sequences`` has (tier, pieces)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self.waiting: list[list[tuple[int, int, int]]] = [[] for _ in self.tiers]  # (length, document, start), sorted
        self.sequences: list[tuple[int, list[Piece]]] = []

    def route(self, doc: int, start: int, length: int) -> None:
        top = self.tiers[-1]
        while length >= top:
            self.sequences.append((top, [(doc, start, top)]))
            start, length = start + top, length - top
        if length:
            bisect.insort(self.waiting[bisect.bisect_left(self.tiers, length)], (length, doc, start))

    def _take(self, tier: int, room: int) -> tuple[int, int, int] | None:
        """The longest piece of at most ``room`` from the tiers up to ``tier``."""
        for k in range(tier, -1, -1):
            at = bisect.bisect_right(self.waiting[k], (room, float("inf"), 0))
            if at:
                return self.waiting[k].pop(at - 1)
        return None

    def _cut(self, tier: int, room: int) -> Piece | None:
        """``room`` tokens off the front of the longest piece, of a shorter tier if there is one."""
        for k in [*range(tier), *range(tier, len(self.tiers))]:
            if self.waiting[k] and self.waiting[k][-1][0] > room:
                length, doc, start = self.waiting[k].pop()
                self.route(doc, start + room, length - room)
                return doc, start, room
        return None

    def pack(self) -> list[Piece]:
        """Pack all that waits; returns the pieces of the window that could not be filled."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[tier]
            while self.waiting[tier]:
                length, doc, start = self.waiting[tier].pop()
                window, room = [(doc, start, length)], size - length
                while room:
                    found = self._take(tier, room)
                    if found:
                        window.append((found[1], found[2], found[0]))
                        room -= found[0]
                    elif part := self._cut(tier, room):
                        window.append(part)
                        room = 0
                    else:
                        return window  # nothing is left in any tier
                self.sequences.append((size, window))
        return []

    def finish(self, rest: list[Piece]) -> None:
        """End of the partition: cut the unfinished window into the tiers' sizes; the remainder
        below the smallest tier is one sequence, to be padded."""
        left, sizes = sum(p[2] for p in rest), []
        for size in reversed(self.tiers):
            sizes += [size] * (left // size)
            left %= size
        rest = rest[::-1]
        for size in [*sizes, *([left] if left else [])]:
            window, room = [], size
            while room:
                doc, start, length = rest.pop()
                use = min(length, room)
                window.append((doc, start, use))
                room -= use
                if use < length:
                    rest.append((doc, start + use, length - use))
            self.sequences.append((size if size in self.tiers else self.tiers[-1], window))


def deal(sequences: list[tuple[int, list[Piece]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Step group of each sequence: by tier and descending attention cost, back and forth over
    as many groups as the tokens make."""
    groups = max(1, round(sum(t for t, _ in sequences) / step_tokens))
    order = sorted(range(len(sequences)), key=lambda i: (-sequences[i][0], -sum(p[2] ** 2 for p in sequences[i][1])))
    out = [0] * len(sequences)
    for k, i in enumerate(order):
        lap, at = divmod(k, groups)
        out[i] = groups - 1 - at if lap % 2 else at
    return out


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pack the ids of all documents, each with ``end_id`` behind it.

    One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    tier, step_group, and with ``with_ids`` the piece's ids (little-endian unsigned 32-bit).
    sequence_id is unique over partitions and the same when a task runs again. Null and empty
    texts have the end id alone; null ids and repeated rows are packed like others; an empty table
    gives no rows; other columns are ignored. A document longer than a group forms a group alone.
    """

    def rows(feed: Iterator[tuple]) -> Iterator[tuple]:
        bpe, tail = wordbpe.load(tokenizer_path), int(end_id).to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 32
        n_sequences = n_steps = 0
        docs: list[tuple[int | None, bytes, int, int]] = []  # id, ids, start of these ids, tokens of the document
        rest: list[Piece] = []
        held = 0

        def flush(last: bool) -> Iterator[tuple]:
            nonlocal n_sequences, n_steps, docs, rest, held
            packer = Packer(tiers)
            for doc, start, length in rest:
                packer.route(doc, start, length)
            n_old = len({p[0] for p in rest})
            for k in range(n_old, len(docs)):
                packer.route(k, 0, len(docs[k][1]) // 4)
            rest = packer.pack()
            if last:
                packer.finish(rest)
                rest = []
            steps = deal(packer.sequences)
            for (tier, window), step in zip(packer.sequences, steps, strict=True):
                offset = 0
                for k, start, length in window:
                    doc_id, ids, skipped, total = docs[k]
                    part = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, skipped + start, length, zlib.crc32(part), total, base + n_sequences, offset, tier, base + n_steps + step)
                    yield (*row, part) if with_ids else row
                    offset += length
                n_sequences += 1
            n_steps += max(steps, default=-1) + 1
            # what is carried on: the ids of unfinished pieces only, each as a document of its own
            docs = [(docs[k][0], docs[k][1][4 * s : 4 * (s + n)], docs[k][2] + s, docs[k][3]) for k, s, n in rest]
            rest = [(i, 0, p[2]) for i, p in enumerate(rest)]
            held = sum(p[2] for p in rest)

        for doc_id, text in feed:
            ids = bpe.ids(text or "") + tail
            docs.append((doc_id, ids, 0, len(ids) // 4))
            held += len(ids) // 4
            if held >= group_tokens:
                yield from flush(False)
        yield from flush(True)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    return map_rows(texts(df, id_col, text_col), rows, schema + (", ids binary" if with_ids else ""), keep="wordbpe")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
