"""Specimen registry: measure specimens as files of their parts arrive, and measure again what new parts change.

    python -m jobs.specimen_registry --config jobs/specimen_registry.json [--parts PATH] [--output PATH] [--checkpoint PATH]

A file stream over a folder or pattern of part files takes what its checkpoint has not seen and then stops. Each
micro-batch

* keeps its parts below ``output``/parts, partitioned by block (``block`` specimens in a row) and batch; parts
  that cannot be used (null or negative key, no size) stand in block -1 with the problem,
* finds the specimens that the new parts belong to, reads the parts of those, of this and earlier batches,
* and writes their measures to ``output``/specimens, partitioned by batch.

A batch that is repeated after a failure replaces its own partitions. A specimen's current row is that
of its latest batch (``current``); earlier rows stay, as its history. A part that comes again replaces the
earlier one; of one key twice in a batch the larger size counts. A specimen is complete with forty parts.
Specimens that no new part belongs to are neither read nor measured again.
"""

from __future__ import annotations

import logging
import sys
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import settings
from voxloom.operators import measures as M
from voxloom.plans import fixtures as X
from voxloom.plans import oracles
from voxloom.session import ConfigError, shared_dir

log = logging.getLogger("jobs.specimen_registry")

INPUT = "p_partkey long, p_size int"
PARTS = "p_partkey long, p_size int, problem string, specimen int, block int, batch long"
SPECIMENS = f"specimen int, parts long, complete boolean, {M.TOPOLOGY}, status string, error string, batch long"
REJECTED = -1


@dataclass(frozen=True)
class Config:
    parts: str = ""
    output: str = ""
    checkpoint: str = ""
    block: int = 256
    files_per_batch: int = 0

    def check(self) -> Config:
        if not self.parts or not self.output or not self.checkpoint:
            raise ConfigError("name parts, output and checkpoint")
        if self.block < 1 or self.files_per_batch < 0:
            raise ConfigError("a block has one specimen at least, a batch no negative number of files")
        return self


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    """Write partitions; those of the same names are replaced, all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def keep_parts(rows: DataFrame, number: int, cfg: Config) -> None:
    rows = rows.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("int").alias("p_size"))
    problem = F.when(~F.coalesce(F.col("p_partkey") >= 0, F.lit(False)), "no key").when(F.col("p_size").isNull(), "no size")
    specimen = F.when(problem.isNull(), F.floor(F.col("p_partkey") / float(X.PARTS)).cast("int"))
    block = F.coalesce(F.floor(specimen / float(cfg.block)).cast("int"), F.lit(REJECTED))
    kept = rows.select("p_partkey", "p_size", problem.alias("problem"), specimen.alias("specimen"), block.alias("block"), F.lit(number).cast("long").alias("batch"))
    _replace(kept.repartition("block"), f"{cfg.output}/parts", "block", "batch")


def measure_changed(spark: SparkSession, number: int, cfg: Config) -> None:
    """Measures of the specimens that batch ``number`` has parts of, from all their parts so far."""
    kept = spark.read.schema(PARTS).parquet(f"{cfg.output}/parts").filter(F.col("block") != REJECTED)
    changed = kept.filter(F.col("batch") == number).select("block", "specimen").distinct()
    # blocks without a changed specimen are not read: their partitions are pruned by the join
    parts = kept.filter(F.col("batch") <= number).join(changed, ["block", "specimen"], "left_semi")
    latest = parts.groupBy("p_partkey").agg(F.max(F.struct("batch", "p_size"))["p_size"].alias("p_size"))
    balls = X.balls_of(latest)
    counts = balls.groupBy("specimen").agg(F.count("*").alias("parts"))
    found = counts.join(M.run(X.volumes_of(balls), M.topology, M.TOPOLOGY), "specimen")
    found = found.withColumn("complete", F.col("parts") == X.PARTS).withColumn("batch", F.lit(number).cast("long"))
    _replace(found.select(*[f.name for f in spark.createDataFrame([], SPECIMENS).schema]), f"{cfg.output}/specimens", "batch")


def take(rows: DataFrame, number: int, cfg: Config) -> None:
    """One micro-batch. Both writes replace what the same batch has written before."""
    spark = rows.sparkSession
    keep_parts(rows, number, cfg)
    mine = spark.read.schema(PARTS).parquet(f"{cfg.output}/parts").filter(F.col("batch") == number)
    read, bad = mine.agg(F.count("*"), F.count_if(F.col("block") == REJECTED)).first()
    measure_changed(spark, number, cfg)
    wrote = spark.read.schema(SPECIMENS).parquet(f"{cfg.output}/specimens").filter(F.col("batch") == number).count()
    log.info("batch %d: read %d parts from %s, %d of them rejected, wrote %d specimens to %s", number, read, cfg.parts, bad, wrote, cfg.output)


def run(spark: SparkSession, cfg: Config) -> DataFrame:
    """Take all files that are new since the checkpoint, wait for the stream to end, and return ``current``."""
    cfg.check()
    reader = spark.readStream.schema(INPUT)
    if cfg.files_per_batch:
        reader = reader.option("maxFilesPerTrigger", cfg.files_per_batch)
    stream = reader.parquet(cfg.parts).writeStream.foreachBatch(lambda rows, number: take(rows, number, cfg)).option("checkpointLocation", cfg.checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    if not stream.recentProgress:
        log.info("nothing new in %s", cfg.parts)
    return current(spark, cfg)


def history(spark: SparkSession, cfg: Config) -> DataFrame:
    """Every measurement of every specimen."""
    return spark.read.schema(SPECIMENS).parquet(f"{cfg.output}/specimens")


def current(spark: SparkSession, cfg: Config) -> DataFrame:
    """The latest row of each specimen. Combined before the shuffle, so a long history costs no more."""
    rows = history(spark, cfg)
    return rows.groupBy("specimen").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "specimen"]), "batch").alias("row")).select("specimen", "row.*")


def job2_specimen_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job on all parts, run twice into one new folder with one checkpoint."""
    base = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    # as a pattern, since a file stream takes folders and patterns, and the table may be one file or a folder
    cfg = Config(parts=f"{sf_dir}/part.parque[t]", output=f"{base}/output", checkpoint=f"{base}/checkpoint")
    run(spark, cfg)
    found = run(spark, cfg)
    return found.select("specimen", "parts", "complete", "bone_voxels", "euler", F.round("connectivity", 6).alias("connectivity"), F.round("breadth", 6).alias("breadth"), "status")


ORACLE_SQL = oracles._with(
    oracles._BASE, oracles._CELLS,
    "n AS (SELECT s, count(*) AS bone FROM bone GROUP BY s)", "held AS (SELECT s, count(*) AS parts FROM balls GROUP BY s)",
    select="""SELECT s AS specimen, parts, parts = 40 AS complete, bone AS bone_voxels, euler::BIGINT AS euler, round((1 - (euler - correction))::DOUBLE, 6) AS connectivity,
  round((breadth * 25)::DOUBLE, 6) AS breadth, 'OK' AS status FROM measures JOIN n USING (s) JOIN held USING (s)""",
)

if __name__ == "__main__":
    sys.exit(settings.main("specimen_registry", Config, run, __doc__.splitlines()[0]))
