"""Cohort report: measure every specimen of a study, compare cohorts with a control, list outliers.

    python -m jobs.cohort_report --config jobs/cohort_report.json [--parts PATH] [--output PATH]

Reads a table of parts (p_partkey, p_size and the column that names the cohort); forty parts in a row are a
specimen, its cohort is that of its first part. Writes below ``output``:

* ``specimens``: one row a specimen, partitioned by cohort
* ``summary``: cohort x measure with n, mean, standard deviation, quartiles, range, and Welch's t against
  the control, partitioned by measure
* ``outliers``: values beyond ``fence`` interquartile ranges of their cohort's quartiles, by cohort
* ``rejected``: parts with a null or negative key or no size

With ``cohorts`` only these are measured and only their partitions replaced; the summary is made of all
specimens that then stand in the folder. Running it again gives the same files' contents. A specimen that
cannot be measured keeps its row with status FAIL and enters no summary. A part with a null or empty cohort is of
the cohort ``unknown``; a key that occurs twice is two parts.
"""

from __future__ import annotations

import logging
import sys
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs import settings
from voxloom.operators import measures as M
from voxloom.operators import relational as R
from voxloom.plans import fixtures as X
from voxloom.plans import oracles
from voxloom.session import ConfigError, shared_dir

log = logging.getLogger("jobs.cohort_report")

#: Measures that are compared, as columns of the topology kernel.
MEASURES = ("bv", "euler", "connectivity", "breadth")
QUARTILES = {0.25: "q1", 0.5: "median", 0.75: "q3"}
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Config:
    parts: str = ""
    output: str = ""
    cohort: str = "p_type"
    control: str = "STANDARD"
    cohorts: tuple[str, ...] = ()
    fence: float = 1.5

    def check(self) -> Config:
        if not self.parts or not self.output:
            raise ConfigError("name parts and output")
        if not self.fence >= 0:
            raise ConfigError("the fence must not be negative")
        return self


def measure(parts: DataFrame, cfg: Config) -> DataFrame:
    """One row a specimen of the wanted cohorts, with its cohort and topology."""
    balls = X.balls_of(parts).select("specimen", "ball", "cx", "cy", "cz", "r")
    # a partition cannot be named by an empty text
    own = F.coalesce(F.nullif(F.col(f"`{cfg.cohort}`").cast("string"), F.lit("")), F.lit(UNKNOWN))
    cohorts = parts.groupBy(F.floor(F.col("p_partkey") / float(X.PARTS)).cast("int").alias("specimen")).agg(F.min(F.struct("p_partkey", own.alias("cohort")))["cohort"].alias("cohort"), F.count("*").alias("parts"))
    if cfg.cohorts:
        cohorts = cohorts.filter(F.col("cohort").isin(*cfg.cohorts))
        balls = balls.join(cohorts.select("specimen"), "specimen", "left_semi")
    return cohorts.join(M.run(X.volumes_of(balls), M.topology, M.TOPOLOGY), "specimen")


def long(specimens: DataFrame) -> DataFrame:
    """(cohort, specimen, measure, value) of what was measured."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in MEASURES])
    return specimens.filter("status = 'OK'").select("cohort", "specimen", F.explode(pairs).alias("x")).select("cohort", "specimen", "x.*")


def summarise(values: DataFrame, control: str) -> DataFrame:
    """One row for each cohort and measure. t and its degrees of freedom are Welch's against the control;
    null for the control itself, for fewer than two specimens and without any spread."""
    by = ["cohort", "measure"]
    base = values.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))
    cuts = R.quantiles(values, by, "value", tuple(QUARTILES)).groupBy(*by).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in QUARTILES.items()])
    # one row a measure: four rows, whatever the input
    beside = base.filter(F.col("cohort") == control).select("measure", F.col("n").alias("n0"), F.col("mean").alias("mean0"), F.col("sd").alias("sd0"))
    both = base.join(cuts, by).join(F.broadcast(beside), "measure", "left")
    a, b = F.col("sd") * F.col("sd") / F.col("n"), F.col("sd0") * F.col("sd0") / F.col("n0")
    fit = (F.col("cohort") != control) & (F.col("n") > 1) & (F.col("n0") > 1) & (a + b > 0)
    df = (a + b) * (a + b) / (a * a / (F.col("n") - 1) + b * b / (F.col("n0") - 1))
    return both.select(
        *by, "n", "mean", "sd", "low", "q1", "median", "q3", "high", (F.col("mean") - F.col("mean0")).alias("difference"),
        F.when(fit, (F.col("mean") - F.col("mean0")) / F.sqrt(a + b)).alias("t"), F.when(fit, df).alias("df"),
    )


def outliers(values: DataFrame, summary: DataFrame, fence: float) -> DataFrame:
    """Values outside q1 - fence * (q3 - q1) to q3 + fence * (q3 - q1) of their cohort."""
    width = fence * (F.col("q3") - F.col("q1"))
    edges = summary.select("cohort", "measure", (F.col("q1") - width).alias("from"), (F.col("q3") + width).alias("to"))
    return values.join(edges, ["cohort", "measure"]).filter((F.col("value") < F.col("from")) | (F.col("value") > F.col("to")))


def run(spark: SparkSession, cfg: Config) -> DataFrame:
    """Run the job; returns ``output`` read back (``result``)."""
    cfg.check()
    out = cfg.output.rstrip("/")
    parts = spark.read.parquet(cfg.parts).select("p_partkey", "p_size", *({cfg.cohort} - {"p_partkey", "p_size"}))
    good = (F.col("p_partkey") >= 0) & F.col("p_size").isNotNull()
    seen = Observation("parts")
    rows = parts.withColumn("good", F.coalesce(good, F.lit(False))).observe(seen, F.count("*").alias("read"), F.count_if("good").alias("good"))
    rows.filter("NOT good").drop("good").write.mode("overwrite").parquet(f"{out}/rejected")
    log.info("read %d parts from %s, %d of them rejected", seen.get["read"], cfg.parts, seen.get["read"] - seen.get["good"])

    # partitions that are not written stay, where only some cohorts are wanted
    mode = "dynamic" if cfg.cohorts else "static"
    measured = measure(parts.filter(good), cfg)
    measured.repartition("cohort", F.pmod(F.xxhash64("specimen"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("cohort").parquet(f"{out}/specimens")
    specimens = _specimens(spark, out)
    values = long(specimens)
    summarise(values, cfg.control).write.mode("overwrite").partitionBy("measure").parquet(f"{out}/summary")
    summary = spark.read.schema(SUMMARY).parquet(f"{out}/summary")
    outliers(values, summary, cfg.fence).write.mode("overwrite").partitionBy("cohort").parquet(f"{out}/outliers")
    found = {r["status"]: r["count"] for r in specimens.groupBy("status").count().collect()}
    log.info("wrote %s specimens (%d failed), %d summary rows, %d outliers to %s", sum(found.values()), found.get("FAIL", 0), summary.count(), spark.read.schema(OUTLIERS).parquet(f"{out}/outliers").count(), out)
    return result(spark, cfg)


SUMMARY = "cohort string, n long, mean double, sd double, low double, q1 double, median double, q3 double, high double, difference double, t double, df double, measure string"
OUTLIERS = "measure string, specimen int, value double, from double, to double, cohort string"
SPECIMENS = f"specimen int, parts long, {M.TOPOLOGY}, status string, error string, cohort string"


def _specimens(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SPECIMENS).parquet(f"{out}/specimens")


def result(spark: SparkSession, cfg: Config) -> DataFrame:
    """The whole output in one long table: (kind, cohort, specimen, measure, statistic, value)."""
    out = cfg.output.rstrip("/")
    none = F.lit(None).cast("int").alias("specimen")
    row = lambda kind, specimen, statistic, value: [F.lit(kind).alias("kind"), "cohort", specimen, "measure", statistic.alias("statistic"), value.alias("value")]
    found = long(_specimens(spark, out)).select(*row("specimen", "specimen", F.lit("value"), F.col("value")))
    named = F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("v")) for c in ("n", "mean", "sd", "low", "q1", "median", "q3", "high", "difference", "t", "df")])
    summary = spark.read.schema(SUMMARY).parquet(f"{out}/summary").withColumn("x", F.explode(named)).select(*row("summary", none, F.col("x.statistic"), F.col("x.v")))
    beyond = spark.read.schema(OUTLIERS).parquet(f"{out}/outliers").select(*row("outlier", "specimen", F.lit("value"), F.col("value")))
    return found.unionByName(summary).unionByName(beyond)


def job1_cohort_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job on all parts, run twice into one new folder."""
    cfg = Config(parts=f"{sf_dir}/part.parquet", output=f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}")
    run(spark, cfg)
    return run(spark, cfg).withColumn("value", F.round("value", 4))


ORACLE_SQL = oracles._with(
    oracles._BASE, oracles._CELLS,
    "n AS (SELECT s, count(*) AS bone FROM bone GROUP BY s)",
    "named AS (SELECT CAST(floor(p_partkey / 40.0) AS INT) AS s, arg_min(coalesce(nullif(p_type, ''), 'unknown'), p_partkey) AS cohort FROM part GROUP BY 1)",
    """v AS (SELECT cohort, s AS specimen, unnest(['bv', 'euler', 'connectivity', 'breadth']) AS measure,
  unnest([bone * 15625.0, euler::DOUBLE, (1 - (euler - correction))::DOUBLE, (breadth * 25)::DOUBLE]::DOUBLE[]) AS value FROM measures JOIN n USING (s) JOIN named USING (s))""",
    """base AS (SELECT cohort, measure, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS low, quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS high FROM v GROUP BY ALL)""",
    """both_ AS (SELECT b.*, b.mean - c.mean AS difference, b.sd * b.sd / b.n AS va, c.sd * c.sd / c.n AS vb, b.cohort <> 'STANDARD' AND b.n > 1 AND c.n > 1 AS fit, c.n AS n0
  FROM base b LEFT JOIN base c ON c.measure = b.measure AND c.cohort = 'STANDARD')""",
    """sums AS (SELECT *, CASE WHEN fit AND va + vb > 0 THEN difference / sqrt(va + vb) END AS t,
  CASE WHEN fit AND va + vb > 0 THEN (va + vb) * (va + vb) / (va * va / (n - 1) + vb * vb / (n0 - 1)) END AS df FROM both_)""",
    select="""SELECT kind, cohort, specimen, measure, statistic, round(value, 4) AS value FROM (
  SELECT 'specimen' AS kind, cohort, specimen, measure, 'value' AS statistic, value FROM v
  UNION ALL SELECT 'outlier', v.cohort, v.specimen, v.measure, 'value', v.value FROM v JOIN base b USING (cohort, measure)
    WHERE v.value < b.q1 - 1.5 * (b.q3 - b.q1) OR v.value > b.q3 + 1.5 * (b.q3 - b.q1)
  UNION ALL SELECT 'summary', cohort, NULL, measure, unnest(['n', 'mean', 'sd', 'low', 'q1', 'median', 'q3', 'high', 'difference', 't', 'df']),
    unnest([n::DOUBLE, mean, sd, low, q1, median, q3, high, difference, t, df]) FROM sums)""",
)

if __name__ == "__main__":
    sys.exit(settings.main("cohort_report", Config, run, __doc__.splitlines()[0]))
