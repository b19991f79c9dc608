"""Near-duplicates by min-max hashing.

Under each permutation of the shingle hashes both the smallest and the largest value are kept:
either agrees between two sets with a chance equal to their Jaccard similarity, so N permutations
give 2 N unbiased signature rows for the price of N. Bands of four rows (two permutations) become
bucket keys. Candidates are confirmed on the full shingle sets, and linked documents are grouped
by connected components.

Work is done between classes: documents of one shingle set are one class with its smallest doc_id
as representative, so copies cost nothing after the first aggregation. In each bucket, members are
first compared with one pivot, not with each other. Buckets whose members then share a component
are settled. In the others no link is given up: small buckets are compared as pairs, large ones by
families of buckets that overlap, through postings with prefix and position filters. The shingles of
a document are ordered with those that the family's first document lacks in front, so the few that
make it different lead, and what the family shares is hardly ever looked up. A pair that reaches the
threshold has its first common shingle early in both; only pairs that do, from different components,
are candidates. They are tried one for each document and component until nothing joins any more,
then all that are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.base import map_rows, materialize, table, texts
from voxloom.llm.components import components
from voxloom.llm.lz_fingerprint import phrase_hashes

PERMUTATIONS, BANDS = 64, 32
WORDS, PERCENT = 5, 80
#: So many members are compared with a pivot in one place; more are dealt out, with the pivot.
MEMBERS_PER_SALT = 256
#: Ids of candidates are broadcast to the scan of the texts up to this number, else joined.
BROADCAST_IDS = 1_000_000
#: Unsettled buckets up to this size are compared as pairs, larger ones by families.
SMALL_BUCKET = 16
#: Documents of a family whose postings are made in one place, with the family's first document.
STREAM = 1024
#: Places that the rows of one bucket key or one posting are dealt to; the other side goes to all.
SALTS = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(3)
_MULTIPLIER = (_RNG.integers(0, 1 << 32, PERMUTATIONS, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_OFFSET = _RNG.integers(0, 1 << 32, PERMUTATIONS, np.uint64).astype(np.uint32)[:, None]
_PLACE = _RNG.integers(0, 1 << 63, 64, np.uint64) | np.uint64(1)
_ROWS = _RNG.integers(0, 1 << 63, 4, np.uint64) | np.uint64(1)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


#: A number for each place in a word and byte. Bytes between words count nothing, so sums run over them.
_LETTERS = 64
_NUMBERS = np.random.default_rng(5).integers(0, 1 << 64, (_LETTERS, 256), np.uint64)
_NUMBERS[:, _GAP] = 0


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, equal for equal words: the sum of the numbers of its bytes at their places, mixed
    with its length. Longer words than the table has places are hashed by themselves."""
    first = int(starts[0])
    size = ends - starts
    place = np.arange(len(raw) - first, dtype=np.int32)
    place -= np.repeat((starts - first).astype(np.int32), np.diff(np.append(starts, len(raw))))
    np.minimum(place, _LETTERS - 1, out=place)
    place <<= 8
    place |= raw[first:]
    h = _mix(np.add.reduceat(_NUMBERS.ravel()[place], starts - first) ^ size.astype(np.uint64))
    long = np.flatnonzero(size > _LETTERS)
    if len(long):
        h[long] = phrase_hashes(raw, starts[long], ends[long])
    return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles. A-Z count as a-z; words are runs
    of anything but space and \\x09-\\x0D; a text of fewer words than a shingle is one shingle of
    all of them; a text without a word has none."""
    raw = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    if not len(raw):
        return np.zeros(0, np.uint64)
    edge = np.empty(len(raw) + 2, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = _GAP[raw]
    turns = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = turns[::2], turns[1::2]
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    w = word_hashes(raw, starts, ends)
    k = min(words, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h += w[i : n - k + 1 + i] * _PLACE[i]
    if k < words:
        h += np.uint64(k) * _PLACE[63]
    return np.unique(_mix(h))


def min_max(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of a non-empty set under each permutation."""
    x = (found >> np.uint64(32)).astype(np.uint32)[None, :]
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, x.shape[1], 4096):
        m = x[:, at : at + 4096] * _MULTIPLIER + _OFFSET
        np.minimum(low, m.min(axis=1), out=low)
        np.maximum(high, m.max(axis=1), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One bucket key for each pair of permutations, from its four rows."""
    four = np.stack([low[0::2], high[0::2], low[1::2], high[1::2]]).astype(np.uint64)
    return _mix((four * _ROWS[:, None]).sum(axis=0, dtype=np.uint64) + _BAND).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if not len(a) or not len(b):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b)) if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) else -1
    return 100 * common >= percent * (len(a) + len(b) - common) if common >= 0 else False


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set, band keys (both null without shingles).
    Narrow: one pass."""

    def rows(feed: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in feed:
            found = shingles(text, words)
            if not len(found):
                yield doc_id, 0, None, None
                continue
            yield doc_id, len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), band_keys(*min_max(found)).tolist()

    return map_rows(texts(df, id_col, text_col), rows, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows by doc_id with their texts; texts of other documents do not leave the scan while the
    wanted ids are few enough to be broadcast."""
    wanted = materialize(rows.select("doc_id").distinct(), "wanted")
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    return rows.join(docs.join(ids, "doc_id", "left_semi"), "doc_id")


def confirm(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, pivot) that are linked on their full sets; ``docs`` has doc_id and text.

    Texts of documents in pairs are fetched once; members meet their pivot in groups of bounded
    size, to each of which the pivot's text goes along. A group streams: memory holds the pivot's
    set and one member. Where several rows have one id, any of their texts may link.
    """
    salts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / MEMBERS_PER_SALT).cast("int").alias("salts"))
    members = pairs.join(salts, "pivot").select("pivot", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.col("a").alias("doc_id"), F.lit(1).alias("member"))
    pivots = salts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("pivot").alias("doc_id"), F.lit(0).alias("member"))
    dealt = (
        _with_text(materialize(members.unionByName(pivots), "dealt"), docs)
        .select("pivot", "salt", "member", "doc_id", "text")
        .repartition("pivot", "salt")
        .sortWithinPartitions("pivot", "salt", "member")
    )

    def rows(feed: Iterator[tuple]) -> Iterator[tuple]:
        group, sets = None, []
        for pivot, salt, member, doc_id, text in feed:
            if (pivot, salt) != group:
                group, sets = (pivot, salt), []
            found = shingles(text, words)
            if not member:
                sets.append(found)
            elif any(linked(s, found, percent) for s in sets):
                yield doc_id, pivot

    return map_rows(dealt, rows, "a long, b long")


def _salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _everywhere(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def postings(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """The leading shingles of each document of a family: family, doc_id, size (of its set), shingle,
    place. ``members`` has family and doc_id; a family is named by its first document.

    The order puts shingles that the first document lacks in front, by hash within either part; it is
    one order for the family, and places up to size - percent * size / 100 are all that a pair at the
    threshold can need. Memory holds the first document's set and one member's.
    """
    salts = members.groupBy("family").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("salts"))
    own = members.join(salts, "family").select("family", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member"), "doc_id")
    first = salts.select("family", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("family").alias("doc_id"))
    dealt = (
        _with_text(materialize(own.unionByName(first), "dealt"), docs)
        .select("family", "salt", "member", "doc_id", "text")
        .repartition("family", "salt")
        .sortWithinPartitions("family", "salt", "member")
    )

    def rows(feed: Iterator[tuple]) -> Iterator[tuple]:
        group, common = None, np.zeros(0, np.uint64)
        for family, salt, member, doc_id, text in feed:
            if (family, salt) != group:
                group, common = (family, salt), np.zeros(0, np.uint64)
            found = shingles(text, words)
            if not member:
                common = np.union1d(common, found)
                continue
            shared = np.isin(found, common, assume_unique=True)
            n = len(found)
            lead = np.concatenate([found[~shared], found[shared]])[: n + 1 - -(-percent * n // 100)]
            for place, v in enumerate(lead.view(np.int64).tolist()):
                yield family, doc_id, n, v, place

    return map_rows(dealt, rows, "family long, doc_id long, size int, shingle long, place int")


def candidates(posted: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b, a_component, b_component, place) of documents of one family in different components with
    a common shingle early enough in both for the threshold; ``a`` lies outside the family's largest
    component. ``component`` has family, doc_id, component. A pair may come up several times."""
    sizes = component.groupBy("family", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("family").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.count("*").alias("parts")).filter("parts > 1")
    known = component.join(largest, "family").select("family", "doc_id", "component", "largest")
    rows = posted.join(known, ["family", "doc_id"])
    side = lambda p: rows.select("family", "shingle", *[F.col(c).alias(f"{p}_{c}") for c in ("doc_id", "component", "size", "place", "largest")])
    a, b = _everywhere(side("a").filter("a_component <> a_largest")), _salted(side("b"), "b_doc_id")
    both = a.join(b.hint("merge"), ["family", "shingle", "salt"])
    need = F.floor((percent * (F.col("a_size") + F.col("b_size")) + 99 + percent) / F.lit(100 + percent))
    early = (F.col("a_place") <= F.col("a_size") - need) & (F.col("b_place") <= F.col("b_size") - need)
    return both.filter((F.col("a_component") != F.col("b_component")) & early).select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b"), "a_component", "b_component", (F.col("a_place") + F.col("b_place")).alias("place"))


def family_links(docs: DataFrame, members: DataFrame, edges: DataFrame, words: int, percent: int) -> list[DataFrame]:
    """Links between different components of families, enough of them that no two components of linked
    documents stay apart. ``members`` has family and doc_id, ``edges`` the links known so far."""
    posted = materialize(postings(docs, members, words, percent), "postings")
    made: list[DataFrame] = []
    tried = None
    while True:
        found = components(reduce(DataFrame.unionByName, made, edges))
        component = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("family", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        rows = candidates(posted, materialize(component, "families"), percent)
        pairs = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("pivot")).distinct()
        if tried is not None:
            rows = rows.withColumn("u", F.least("a", "b")).withColumn("v", F.greatest("a", "b")).join(tried.select(F.col("a").alias("u"), F.col("pivot").alias("v")), ["u", "v"], "left_anti")
        # the likeliest partner of each document in each other component
        one = pairs(rows.groupBy("a", "b_component").agg(F.min(F.struct("place", "b"))["b"].alias("b")))
        one = materialize(one, "pairs")
        if one.isEmpty():
            return made
        links = materialize(confirm(docs, one, words, percent), "links")
        tried = one if tried is None else tried.unionByName(one)
        if links.isEmpty():
            # nothing joins by likeliest partners: all that are left
            made.append(materialize(confirm(docs, materialize(pairs(rows).join(one, ["a", "pivot"], "left_anti"), "pairs"), words, percent), "links"))
            return made
        made.append(links)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Groups of near-duplicates: doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets have 100 * intersection >= percent * union are linked;
    component_id is the smallest doc_id reachable, kept says that it is the row's own. Null, empty
    and wordless texts have no shingles and stand alone. Rows without an id are returned with null
    component_id and kept, and link nothing. Rows that share an id are one document with several
    texts. An empty table gives no rows; other columns are ignored.

    A pair at the threshold shares a band with a chance of 1 - 5e-8, one above it a greater one.
    """
    docs = texts(df, id_col, text_col)
    sig = materialize(signatures(docs, words=words), "signatures")
    with_id = sig.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialize(with_id.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    # one row a class, however often its first document is repeated
    firsts = with_id.select("doc_id", "digest", "bands").join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    keys = _salted(firsts.select(F.col("doc_id").alias("a"), F.explode("bands").alias("key")), "a")
    # rows of one key are summed and joined in several places
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("a").alias("pivot")).filter("n > 1")
    members = materialize(keys.join(_everywhere(shared), ["key", "salt"]), "members")
    pairs = materialize(members.filter("a <> pivot").select("a", "pivot").distinct(), "pairs")
    edges = materialize(confirm(docs, pairs, words, percent), "links")
    found = materialize(components(edges), "components")
    left = members.select("key", "salt", "a", "n").join(found.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    # a bucket of two has been compared; of the others, those in one component are settled
    mixed = left.filter("n > 2").groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("a").alias("first")).filter("lo <> hi").select("key", "first")
    left = materialize(left.join(_everywhere(mixed), ["key", "salt"]), "unsettled")
    small = left.filter(F.col("n") <= SMALL_BUCKET)
    other = small.select("key", F.col("a").alias("pivot"), F.col("component").alias("of"))
    again = small.join(other, "key").filter("a > pivot AND component <> of").select("a", "pivot").distinct().join(pairs, ["a", "pivot"], "left_anti")
    again = materialize(again, "pairs")
    more = materialize(confirm(docs, again, words, percent), "links")
    known = edges.unionByName(more)
    large = left.filter(F.col("n") > SMALL_BUCKET)
    if not large.isEmpty():
        family = components(large.select(F.col("first").alias("a"), F.col("a").alias("b"))).withColumnRenamed("component", "family")
        of_family = materialize(family.select("family", F.col("node").alias("doc_id")), "families")
        known = reduce(DataFrame.unionByName, family_links(docs, of_family, known, words, percent), known)
        found = materialize(components(known), "components")
    elif not more.isEmpty():
        found = materialize(components(known), "components")
    grouped = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    # documents without shingles or id stay out of the join on the digest
    inside = with_id.join(grouped, "digest").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    outside = sig.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return inside.unionByName(outside).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op3_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


#: The same result by brute force over shared shingles.
ORACLE_SQL = r"""WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM docs WHERE len(w) > 0),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM spots),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM size UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.doc_id WHERE ways.b > reach.root),
root AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, documents.doc_id) AS component_id, coalesce(root, documents.doc_id) = documents.doc_id AS kept
FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN root USING (doc_id)"""
