"""Sharding by proportional stratified interleaving, in DataFrame functions alone.

Rows of each source are ranked in a seeded random order. Row r (from 0) of a source with n rows has the
fractional rank (2 r + 1) / 2 n; sorted by it, sources alternate in proportion, and the sequence is cut
into shards whose row counts differ by one at most. A shard holds n / shards rows of a source, give or
take one and the source's share of half a row for each source.

No task gets a whole source, shard or group of copies: ranks are counted within ranges of the order, whose
starts are running sums over the ranges. The random order is even, so ranges hold RANGE_ROWS rows whatever
the sources are; fractional ranks of a source are evenly spaced, so ranges of them hold at most RANGE_ROWS
and one row a source. Rows equal in id, source and text are one row with a number of copies until then.
Texts are read once and not shuffled.

A null source counts as the empty one, a null text has no bytes; ids may be null or repeat. The order
depends on seed, id, source and text only: not on files or partitions. Rows equal in all of these are
interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm.base import materialize, table

SHARDS, SEED = 8, 11
#: Rows of a range, which one task ranks.
RANGE_ROWS = 1 << 11
#: Copies of a row that one task writes out; more are dealt out first.
COPIES = 4096
#: Ranges in a block of the running sum over all of them.
BLOCK = 1024

_ID = ["source", "hash", "doc_id", "size", "text_crc32"]


def _keyed(docs: DataFrame, seed: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    key, source = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    own = F.col(f"`{text_col}`").cast("string")
    text = F.coalesce(own, F.lit("")).cast("binary")
    hash_ = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")), F.md5(text), source).cast("binary"))
    return docs.select(key.alias("doc_id"), source.alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), hash_.alias("hash"), own.alias("text"))


def slim(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """What the sharding knows of a row: id, source, size in bytes and one, crc32, and the hash of the random order."""
    return _keyed(docs, seed, id_col, source_col, text_col).drop("text")


def _start(ranges: DataFrame, by: list[str]) -> DataFrame:
    """For rows (by, range, amount), one for each range: the sum of the amounts of all ranges before it (start).
    In two steps, by blocks of ranges, so that a task sees BLOCK ranges or all blocks of a key."""
    order = lambda keys, at: Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("amount").over(w), F.lit(0))
    rows = ranges.withColumn("block", F.expr(f"range div {BLOCK}L"))
    blocks = rows.groupBy(*by, "block").agg(F.sum("amount").alias("amount")).select(*by, "block", before(order(by, "block")).alias("earlier"))
    inner = rows.select(*by, "block", "range", before(order([*by, "block"], "range")).alias("inside"))
    return inner.join(blocks, [*by, "block"]).select(*by, "range", (F.col("earlier") + F.col("inside")).alias("start"))


def _ordered(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, int]:
    # equal rows are counted, not kept
    rows = materialize(slim(docs, seed, id_col, source_col, text_col).groupBy(*_ID).agg(F.count("*").alias("copies")), "shard-rows")
    n = rows.agg(F.sum("copies")).first()[0] or 0
    ranges = 1 + n // RANGE_ROWS
    # eight hexadecimal digits are a number below 2**32, whose share of the whole picks the range
    rows = rows.withColumn("range", F.expr(f"shiftright(conv(substr(hash, 1, 8), 16, 10)::long * {ranges}L, 32)"))

    amounts = rows.groupBy("source", "range").agg(F.sum("copies").alias("amount"))
    totals = amounts.groupBy("source").agg(F.sum("amount").alias("total"))
    starts = _start(amounts, ["source"]).join(totals, "source")
    order = Window.partitionBy("source", "range").orderBy("hash", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("before", F.coalesce(F.sum("copies").over(order), F.lit(0))).join(starts, ["source", "range"])
    ranked = ranked.select(*_ID, "copies", (F.col("start") + F.col("before")).alias("first"), "total")

    few = ranked.filter(F.col("copies") <= COPIES).select("*", F.explode(F.expr("sequence(0L, copies - 1)")).alias("copy"))
    many = ranked.filter(F.col("copies") > COPIES).select("*", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES}L)")).alias("part"))
    many = many.repartition("hash", "part").select("*", F.explode(F.expr(f"sequence(part * {COPIES}L, least(copies, (part + 1) * {COPIES}L) - 1)")).alias("copy")).drop("part")
    every = few.unionByName(many).select(*_ID, (F.col("first") + F.col("copy")).alias("source_rank"), "total")
    every = every.withColumn("fraction", (2 * F.col("source_rank") + 1).cast("double") / (2 * F.col("total")).cast("double")).drop("total")
    every = materialize(every.withColumn("range", F.floor(F.col("fraction") * ranges).cast("long")), "shard-ranks")

    amounts = every.groupBy("range").agg(F.count("*").alias("amount")).withColumn("all", F.lit(0))
    starts = _start(amounts, ["all"]).select("range", "start")
    place = F.row_number().over(Window.partitionBy("range").orderBy("fraction", "source", "source_rank"))
    found = every.withColumn("place", place).join(starts, "range")
    return found.select("doc_id", "source", "size", "text_crc32", "hash", "source_rank", "fraction", (F.col("start") + F.col("place") - 1).alias("position")), n


def interleave(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Every row as (doc_id, source, size, text_crc32, hash, source_rank, fraction, position): its place in the
    random order of its source, and in the whole sequence, from 0 without gaps."""
    return _ordered(docs, seed, id_col, source_col, text_col)[0]


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``interleave`` with law (rows), shard and slot (from 0 within the shard, without gaps)."""
    if shards < 1:
        raise ValueError("at least one shard")
    rows, n = _ordered(docs, seed, id_col, source_col, text_col)
    found = rows.withColumn("shard", F.expr(f"(position * {shards}L div {max(n, 1)}L)::int")).withColumn("law", F.lit("rows"))
    return found.withColumn("slot", F.expr(f"position - (shard * {n}L + {shards - 1}L) div {shards}L"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Write the documents (doc_id, source, text, slot) under ``path``/shard=k, files in ascending slots, and
    return them read back. Texts are joined to their places by the row's hash, once for all copies of a row; of a
    row that occurs with null and with empty text the empty one is written."""
    spark = docs.sparkSession
    placed = assign_shards(docs, shards, seed, id_col, source_col, text_col).select("doc_id", "source", "hash", "shard", "slot")
    own = _keyed(docs, seed, id_col, source_col, text_col).groupBy("hash").agg(F.max("text").alias("text"))
    full = placed.join(own, "hash").select("doc_id", "source", "text", "shard", "slot")
    full.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.parquet(path)


def op11_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the law ``rows``; source and position follow the contract's columns."""
    found = assign_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "source_rank", "position")


#: The whole order by one sort; crc32 by its table.
ORACLE_SQL = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
h AS (
  SELECT doc_id, source, strlen(text) + 1 AS size, md5(concat_ws('|', '11', coalesce(doc_id::VARCHAR, 'null'), md5(text), source)) AS hash,
    list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM d),
c AS (
  SELECT doc_id, source, size, hash, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM h, tab),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY hash, doc_id NULLS FIRST, size, text_crc32) - 1 AS source_rank, count(*) OVER (PARTITION BY source) AS total FROM c),
p AS (
  SELECT *, row_number() OVER (ORDER BY (2 * source_rank + 1)::DOUBLE / (2 * total)::DOUBLE, source, source_rank) - 1 AS position, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (position * 8 // n)::INTEGER AS shard, position - (position * 8 // n * n + 7) // 8 AS slot,
  NULL::INTEGER AS grown_shard, source, source_rank, position FROM p
"""
