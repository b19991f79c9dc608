"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases as LZ78 does: each phrase is the longest one known
plus one character. The set of phrases, hashed, is kept as its K smallest hashes. Two such
minimum-hash signatures estimate the share of common phrases, a compression-like similarity:
texts that compress well with each other's dictionary have many phrases in common.

Phrase hashes come from one prefix-hash array for each text, so parsing only notes where phrases
end, and all hashing is array work.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.base import map_rows, split_ranges, table, texts

K = 128
def parse(text: str, known: set[str], ends: list[int], at: int = 0, part: str = "") -> str:
    """Parse on from position ``at`` with an open phrase ``part``: adds phrases to ``known`` and their end
    positions to ``ends``; returns the phrase that is still open."""
    add, note = known.add, ends.append
    for c in text:
        at += 1
        part += c
        if part not in known:
            add(part)
            note(at)
            part = ""
    return part


#: Elements that are hashed at a time; a range is never cut.
HASHED = 1 << 18


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def phrase_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each range of elements (code points or bytes), equal for equal strings wherever they
    stand. Every element is scattered together with its place in the range before the sum is taken, so no
    pattern of elements cancels out, as patterns do in powers of a base."""
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    upto = np.cumsum(size)
    at = 0
    while at < len(starts):
        done = int(upto[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + HASHED, "right")))
        n = size[at:to]
        first = upto[at:to] - n - done
        place = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        x = points[np.repeat(starts[at:to], n) + place].astype(np.uint64)
        x |= (place + 1).astype(np.uint64) << np.uint64(21)  # code points have 21 bits
        x *= np.uint64(0x9E3779B97F4A7C15)
        out[at:to] = np.add.reduceat(_scatter(x), first)
        at = to
    return _scatter(out ^ (size.astype(np.uint64) << np.uint64(1)))


def signature(text: str, ends: list[int], open_at: int) -> np.ndarray:
    """The K smallest 32-bit hashes of the phrase set. A phrase still open at the end of the
    text repeats one of the set and adds nothing."""
    if not ends:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    stop = np.asarray(ends, np.int64)
    start = np.empty_like(stop)
    start[0], start[1:] = 0, stop[:-1]
    h = (phrase_hashes(points, start, stop) >> np.uint64(32)).astype(np.uint32)
    if len(h) > 4 * K:
        h = np.partition(h, 2 * K)[: 2 * K]  # phrases are distinct, so these hold the K smallest
    return np.unique(h)[:K]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases: the common part of the K smallest of the union. Two
    empty texts are alike."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    distinct = np.flatnonzero(np.concatenate([[True], ~twice]))[:K]
    return float(np.count_nonzero(np.concatenate([twice, [False]])[distinct]) / len(distinct))


def written(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def of_text(text: str | None) -> np.ndarray:
    """Signature of one text; null counts as empty."""
    text = text or ""
    ends: list[int] = []
    parse(text, set(), ends)
    return signature(text, ends, len(text))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text: doc_id, n_chars, n_phrases, fingerprint.

    Narrow: no shuffle. Equal texts have equal fingerprints; null and empty texts have 0 phrases
    and the empty fingerprint; null ids and repeated rows pass through; an empty table gives no
    rows; other columns are ignored.
    """

    def rows(feed: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in feed:
            text, ends = text or "", []
            parse(text, set(), ends)
            yield doc_id, len(text), len(ends), written(signature(text, ends, len(text)))

    return map_rows(texts(df, id_col, text_col), rows, "doc_id long, n_chars long, n_phrases long, fingerprint string")


def against_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text beside its edited text, whose last floor(n / 2) code points are replaced by the
    first as many of the next document in doc_id order: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are shuffled once, to ranges of doc_id. The first document of a range also goes to the
    range before it (that of the first range to the last), so neighbours always meet and no
    single task sees all rows. The edited text shares its first half's parse. Rows with null ids
    come last in the order, rows of one id are ordered by text; where an id (or null) fills more than
    a range, its rows are ordered by a hash of the text first and dealt over several ranges. An
    empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    rows_in = texts(df, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = split_ranges(rows_in, "key", 4 * parts)
    at = rows_in.withColumn("hash", ranges.hash(F.col("key"), F.col("text"))).withColumn("bucket", ranges.number(F.col("key"), F.col("hash")))
    # ranges without a row have no first document: the range before the next one that has takes it
    order = F.struct("key", "hash")
    if ranges.hot:
        firsts = {r["bucket"]: (r["o"]["key"], r["o"]["hash"]) for r in at.groupBy("bucket").agg(F.min(order).alias("o")).collect()}
    else:
        firsts = {k: (c, 0) for k, c in enumerate(ranges.cuts)}
    held = sorted(firsts)
    before = {b: held[k - 1] for k, b in enumerate(held)}
    column = lambda values: F.lit(np.array([*values, 0], np.int64))
    spot = F.col("bucket") + 1
    first_key, first_hash, last = (column([v(b) for b in range(ranges.n)]) for v in (lambda b: firsts.get(b, (0, -1))[0], lambda b: firsts.get(b, (0, -1))[1], lambda b: before.get(b, 0)))
    is_first = (F.try_element_at(first_key, spot) == F.col("key")) & (F.try_element_at(first_hash, spot) == F.col("hash"))
    to = F.when(is_first, F.array(F.col("bucket"), F.try_element_at(last, spot).cast("int"))).otherwise(F.array("bucket"))
    dealt = (
        at.select("doc_id", "text", "key", "hash", F.posexplode(to).alias("halo", "bucket"))
        .select("bucket", "halo", "key", "hash", "doc_id", "text")
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "halo", "key", "hash", "text")
        .select("bucket", "halo", "doc_id", "text")
    )

    def rows(feed: Iterator[tuple]) -> Iterator[tuple]:
        bucket = held = None

        def step(row: tuple | None, ends: list[int], after: str, sig_after: np.ndarray, sig: np.ndarray, half: tuple) -> tuple:
            doc_id, text = row
            keep = len(text) - len(text) // 2
            edited = text[:keep] + after[: len(text) // 2]
            part, known, cut = half
            parse(edited[keep:], known, cut, keep, part)
            sig_edited = signature(edited, cut, len(edited))
            digest = hashlib.sha256(edited.encode()).hexdigest()
            return doc_id, len(text), digest, written(sig), written(sig_edited), likeness(sig, sig_edited), likeness(sig, sig_after)

        def parsed(text: str) -> tuple[np.ndarray, tuple]:
            keep = len(text) - len(text) // 2
            known: set[str] = set()
            ends: list[int] = []
            part = parse(text[:keep], known, ends)
            half = part, known.copy(), ends.copy()
            parse(text[keep:], known, ends, keep, part)
            return signature(text, ends, len(text)), half

        closed = False
        for b, halo, doc_id, text in feed:
            text = text or ""
            if b != bucket:
                bucket, held, closed = b, None, False
            if closed:
                continue  # more rows of the next range's first id
            closed = halo == 1
            sig, half = parsed(text)
            if held:
                yield step(held[0], [], text, sig, held[1], held[2])
            held = None if closed else ((doc_id, text), sig, half)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_rows(dealt, rows, schema)


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_next(table(spark, sf_dir, "documents"))
