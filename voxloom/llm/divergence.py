"""Source divergence audit: which terms a source uses more than its language does, and how far apart
the sources of a language are.

Terms are runs of letters of ASCII and of characters beyond it; A-Z count as a-z. A language keeps the
terms of at least ``MIN_DOCS`` of its documents. A group is a (language, source); its probability of a
term is ``1 + floor(10**9 * (count + 1) / (N + V))`` and the divergence of p from q is
``floor((p - q)**2 / q)``, all in whole numbers.

* Terms: a group's terms lie in buckets by classes of its count and of the language's count. The largest
  p and the smallest q of a bucket bound its divergences. Buckets are evaluated best bound first, in waves
  for all groups at once, until the bounds of all unseen buckets of a group are strictly below its k-th
  value. Only evaluated terms are ranked, and at most k a group and task are shuffled.
* Pairs: postings (the groups of a term) give the terms two groups share; what a group's other terms add
  depends on their count alone, so a histogram of counts gives it.

Nulls are empty strings. Rows are documents whatever their id, repeated rows count again. A group without
terms has p = 1 + floor(10**9 / V) for all terms; where V is 0 pairs have value 0 and there are no terms.
An empty table gives no rows. Counts up to 9.2e15 are exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm.base import materialize, release, small_batches, table

MIN_DOCS = 3
TOP = 200
#: A side of a join is broadcast up to this number of rows (some 10 MB), beyond it both are shuffled.
BROADCAST_ROWS = 100_000
#: Rows of one key that a task should get where a join's both sides are shuffled.
ROWS_A_PLACE = 2_000_000
#: A wave evaluates buckets until a group has so many times the rows of the wave before.
WAVE = 16
#: Distinct terms a task holds before it passes them on, bytes of a text taken apart at a time, and pairs
#: of a posting's groups computed at a time.
HELD, WINDOW, PAIRS = 500_000, 1 << 20, 1 << 20

_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def _windows(text: bytes) -> Iterator[bytes]:
    """A text cut between terms, so that a long one is never held as one list of terms."""
    at = 0
    while len(text) - at > WINDOW:
        gap = _GAP.search(text, at + WINDOW)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 1 << 16):
                some = terms[at : at + (1 << 16)]
                k = len(some)
                cols = [pa.repeat(lang, k), pa.repeat(source, k), pa.array(some, pa.binary()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, schema=_COUNTS)
        held.clear()

    size = 0
    for b in batches:
        for lang, source, text in zip(*b.columns, strict=True):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before = len(n)
            seen: set[bytes] = set()
            for part in _windows(text.as_py()):
                found = _TERM.findall(part.lower())  # of bytes: A-Z only
                n.update(found)
                seen.update(found)
            docs.update(seen)
            size += len(n) - before
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def count_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and documents that hold it."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    read = docs.select(_name(lang_col).alias("lang"), _name(source_col).alias("source"), text.alias("text"))
    found = read.mapInArrow(_tally, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _name(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def postings(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, size_class, posts of (source, n, count_class)) of kept terms. A posting has at most as
    many entries as the language has sources, of which the result has a row for every pair. Counts are
    already one row a term and group: they are dealt by term as they are, nothing is left to combine before."""
    dealt = counts.repartition("lang", "term")
    whole = dealt.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n", F.expr(_class("n")).alias("count_class"))).alias("posts"))
    return whole.filter(F.col("docs") >= min_docs).select("lang", "term", "total", F.expr("length(bin(total))").alias("size_class"), "posts")


def groups_of(docs: DataFrame, posts: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, gid, size, terms, lang_size, p0): every group that occurs; gid counts the sources of a
    language from 0, size is N of the group, terms V, p0 the probability of a term that it lacks."""
    every = docs.select(_name(lang_col).alias("lang"), _name(source_col).alias("source")).distinct()
    sizes = _rows(posts).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = posts.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_size"))
    found = every.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "terms", "lang_size"])
    found = found.withColumn("gid", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int"))
    return found.withColumn("p0", probability("0", "size", "terms"))


def probability(n: str, size: str, terms: str) -> Column:
    """1 + floor(10**9 * (n + 1) / (size + terms)) by long division, three digits at a time; null for 0 / 0."""
    d = f"nullif({size} + {terms}, 0)"
    a = f"1000L * ({n} + 1)"
    b = f"1000L * (({a}) % {d})"
    c = f"1000L * (({b}) % {d})"
    return F.expr(f"1 + 1000000L * (({a}) div {d}) + 1000L * (({b}) div {d}) + ({c}) div {d}")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _rows(posts: DataFrame) -> DataFrame:
    found = posts.select("lang", "term", "total", "size_class", F.explode("posts").alias("post"))
    return found.select("lang", "term", "total", "post.source", "post.n", (F.col("post.count_class") * 64 + F.col("size_class")).alias("bucket"))


def _beside(rows: DataFrame, small: DataFrame, keys: list[str], by: list[str], n_rows: int) -> DataFrame:
    """Join with a table that is broadcast while it has at most BROADCAST_ROWS rows. A larger one goes to
    several places for each key, to which the rows are dealt by other columns; the number of places
    grows with the rows, so a key with a third of them stays within a task."""
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), keys)
    places = 1 + n_rows // ROWS_A_PLACE
    dealt = rows.withColumn("place", F.pmod(F.xxhash64(*by), F.lit(places)).cast("int"))
    every = small.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(places - 1).cast("int"))))
    return dealt.join(every, [*keys, "place"]).drop("place")


def _class(n: str) -> str:
    """Counts below 16 are classes of their own, larger ones share one with counts of the same four leading bits."""
    return f"length(bin({n})) * 8 + (shiftright({n}, greatest(length(bin({n})) - 4, 0)) & 7)"


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("term"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_terms(posts: DataFrame, groups: DataFrame, k: int = TOP) -> DataFrame:
    """(lang, source, term, n, p, q, value, rank): the k terms of each group that diverge most upwards from
    its language (p > q), by value and then by the bytes of the term."""
    n_rows = posts.agg(F.sum(F.size("posts"))).first()[0] or 0
    sizes = groups.select("lang", "source", "size", "terms", "lang_size")

    def scored(found: DataFrame) -> DataFrame:
        found = _beside(found, sizes, ["lang", "source"], ["term"], n_rows)
        p, q = probability("n", "size", "terms").alias("p"), probability("total", "lang_size", "terms").alias("q")
        return found.select("lang", "source", "term", "n", "bucket", p, q).filter("p > q")

    rows = _rows(posts)
    buckets = scored(rows).groupBy("lang", "source", "bucket").agg(F.count("*").alias("members"), F.max("p").alias("p_high"), F.min("q").alias("q_low"))
    buckets = buckets.withColumn("bound", divergence("p_high", "q_low"))
    ahead = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), F.asc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = materialize(buckets.withColumn("ahead", F.coalesce(F.sum("members").over(ahead), F.lit(0))), "divergence-buckets")

    best: DataFrame | None = None
    low, high = 0, k
    while True:
        unseen = buckets.filter(F.col("ahead") >= low)
        if best is not None:
            kth = best.groupBy("lang", "source").agg(F.count("*").alias("have"), F.min("value").alias("kth")).filter(F.col("have") >= k)
            unseen = unseen.join(kth, ["lang", "source"], "left").filter("kth IS NULL OR bound >= kth")
            if unseen.isEmpty():
                break
        wave = unseen.filter(F.col("ahead") < high).select("lang", "source", "bucket")
        seen = scored(_beside(rows, wave, ["lang", "source", "bucket"], ["term"], n_rows))
        seen = seen.select("lang", "source", "term", "n", "p", "q", divergence("p", "q").alias("value"))
        both = seen if best is None else best.drop("rank").unionByName(seen)
        best = materialize(_best(both, k), "divergence-terms")
        low, high = high, high * WAVE
    return best


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _sums(lang: str, start: np.ndarray, size: np.ndarray, g: np.ndarray, p: np.ndarray, z: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What the terms that two groups share add to what each adds by itself, for postings of one language
    given by start and size in the lists of groups g, their p and their z; summed within chunks."""
    for length in np.unique(size[size > 1]):
        at = start[size == length]
        step = max(1, PAIRS // int(length) ** 2)
        part = max(1, PAIRS // int(length))  # rows of one posting's pairs, where they are more than PAIRS
        for i in range(0, len(at), step):
            take = at[i : i + step, None] + np.arange(length)
            for j in range(0, int(length), part):
                one, all_ = take[:, j : j + part, None], take[:, None, :]
                more = _f(p[one], p[all_]) - _f(p[one], z[all_]) - _f(z[one], p[all_]) + _f(z[one], z[all_])
                key = (g[one] << 32 | g[all_]).ravel()
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                sums = np.add.reduceat(more.ravel()[order], first)
                left, right = key[first] >> 32, key[first] & 0xFFFFFFFF
                keep = left != right
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, int(keep.sum())), pa.array(left[keep], pa.int32()), pa.array(right[keep], pa.int32()), pa.array(sums[keep], pa.int64())], names=["lang", "g", "h", "v"])


def _by_lang(b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Languages of a batch of (lang, lists), with start and size of their lists."""
    langs = b.column(0).dictionary_encode()
    start = b.column(1).offsets.to_numpy().astype(np.int64)
    size = np.diff(start)
    index = langs.indices.to_numpy()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, start[:-1][index == k], size[index == k]


def _shared_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        g, p, z = (b.column(1).values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        for lang, start, size in _by_lang(b):
            yield from _sums(lang, start, size, g, p, z)


def _shared_known(known: dict[str, dict[str, tuple[int, int, int, int]]]):
    """The same for postings as they are: ``known`` has gid, size, terms and p0 of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            lists = b.column(1).values
            source = lists.field(0).dictionary_encode()
            n = lists.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lang, start, size in _by_lang(b):
                own = np.array([known[lang].get(s, (0, 0, 1, 1)) for s in source.dictionary.to_pylist()], np.int64).reshape(-1, 4)
                g, total, terms, z = own[source.indices.to_numpy()].T
                yield from _sums(lang, start, size, g, _probability(n, total + terms), z)

    return run


def _probability(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """``probability`` in arrays."""
    p, rest = np.zeros_like(n), n + 1
    for _ in range(3):
        rest = rest * 1000
        p, rest = p * 1000 + rest // d, rest % d
    return p + 1


def pair_divergences(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, value, rank): the divergence of each group from every other source of its
    language, summed over all kept terms.

    With z for the probability of a lacking term the sum over all terms is V * f(z, z) and, for terms of
    the first group, f(p, z) - f(z, z), for terms of the other f(z, q) - f(z, z); terms of both add
    f(p, q) - f(p, z) - f(z, q) + f(z, z).
    """
    whole = "decimal(38,0)"
    n_rows = posts.agg(F.sum(F.size("posts"))).first()[0] or 0
    other = groups.select("lang", F.col("gid").alias("h"), F.col("p0").alias("z"))
    n_groups = groups.count()
    base = _beside(groups.select("lang", F.col("gid").alias("g"), "terms", "p0"), other, ["lang"], ["g"], n_groups * 1000).filter("g <> h")
    base = base.select("lang", "g", "h", F.coalesce(F.col("terms").cast(whole) * divergence("p0", "z"), F.lit(0)).cast(whole).alias("v"))

    near = groups.select("lang", "source", "gid", "size", "terms", "p0")
    counts = _rows(posts).groupBy("lang", "source", "n").agg(F.count("*").alias("k"))
    counts = _beside(counts, near, ["lang", "source"], ["n"], n_rows).select("lang", F.col("gid").alias("g"), probability("n", "size", "terms").alias("p"), "p0", "k")
    alone = _beside(counts, other, ["lang"], ["g", "p"], n_rows).filter("g <> h")
    mine, theirs = divergence("p", "z") - divergence("p0", "z"), divergence("z", "p") - divergence("z", "p0")
    alone = alone.groupBy("lang", "g", "h").agg(F.sum(F.col("k").cast(whole) * mine).cast(whole).alias("mine"), F.sum(F.col("k").cast(whole) * theirs).cast(whole).alias("theirs"))
    alone = alone.select("lang", F.explode(F.array(F.struct("g", "h", F.col("mine").alias("v")), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), F.col("theirs").alias("v")))).alias("x")).select("lang", "x.*")

    out = "lang string, g int, h int, v long"
    if n_groups <= BROADCAST_ROWS:
        known: dict[str, dict[str, tuple[int, int, int, int]]] = {}
        for r in near.filter("terms > 0").toLocalIterator():
            known.setdefault(r["lang"], {})[r["source"]] = (r["gid"], r["size"], r["terms"], r["p0"])
        shared = posts.filter(F.size("posts") > 1).select("lang", "posts").mapInArrow(_shared_known(known), out)
    else:
        rows = _beside(_rows(posts.filter(F.size("posts") > 1)), near, ["lang", "source"], ["term"], n_rows)
        rows = rows.select("lang", "term", F.struct("gid", probability("n", "size", "terms").alias("p"), "p0").alias("group"))
        shared = rows.groupBy("lang", "term").agg(F.collect_list("group").alias("groups")).select("lang", "groups").mapInArrow(_shared_listed, out)
    shared = shared.groupBy("lang", "g", "h").agg(F.sum(F.col("v").cast(whole)).cast(whole).alias("v"))

    sums = base.unionByName(alone).unionByName(shared).groupBy("lang", "g", "h").agg(F.sum("v").cast("long").alias("value"))
    named = groups.select("lang", F.col("gid").alias("g"), "source")
    found = _beside(sums, named, ["lang", "g"], ["h"], n_groups * 1000)
    found = _beside(found, named.select("lang", F.col("g").alias("h"), F.col("source").alias("other")), ["lang", "h"], ["g"], n_groups * 1000)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("other"))
    return found.select("lang", "source", "other", "value", F.row_number().over(w).alias("rank"))


def audit(docs: DataFrame, k: int = TOP, min_docs: int = MIN_DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The pairs and the terms of a table of documents: (pair_divergences, top_terms)."""
    posts = materialize(postings(count_terms(docs, lang_col, source_col, text_col), min_docs), "divergence-postings")
    groups = materialize(groups_of(docs, posts, lang_col, source_col), "divergence-groups")
    return pair_divergences(posts, groups), top_terms(posts, groups, k)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parts of the audit of all documents as rows (lang, source, part, item, value, rank)."""
    pairs, terms = audit(table(spark, sf_dir, "documents"))
    one = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", "rank")
    return one.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


#: The same by brute force: every kept term of every group and of every pair of groups.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT row_id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY t.lang, t.source, t.term),
size AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.n, 0) + l.v) AS p,
    1 + 1000000000::HUGEINT * (k.total + 1) // (l.n + l.v) AS q
  FROM grp g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN size s USING (lang, source)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
