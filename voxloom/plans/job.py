"""From folders of TIFF files to result rows: what the command line runs."""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import report
from voxloom.session import Config, cut
from voxloom.sources import spacing, tiff


class InputError(ValueError):
    pass


#: Failed specimens that are printed.
MOST_PRINTED = 100


def relative(root: str) -> Column:
    """Path below a folder, whatever scheme Spark puts before it."""
    return F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.split("://", 1)[-1].rstrip("/")) + "/", "")


def load(spark: SparkSession, cfg: Config) -> DataFrame:
    """Volumes of a configuration with their problems, if any: each file is decoded where it is read,
    bones and regions are joined once by relative path, as packed volumes; spacing by precedence:
    voxel size, table, calibrated folder, own calibration. Missing regions and table rows fail at
    once, unless the run goes on after errors; regions then become the specimen's problem."""
    files = tiff.discover(spark, cfg.binary_dir, cfg.subdirs)
    names = files.select("path", spacing.base_name(F.col("path")).alias("name"))
    if names.isEmpty():
        raise InputError("no TIFF files")
    own = F.when(spacing.isotropy(F.col("x_um"), F.col("y_um"), F.col("z_um")).isNull(), F.col("x_um"))
    bones = tiff.volumes(spark, files, cfg.threshold, "strict" if cfg.strict else "any").withColumn("specimen", relative(cfg.binary_dir))
    if cfg.voxel_size is not None:
        bones = bones.withColumn("h_um", F.lit(float(cfg.voxel_size)))
    elif cfg.spacing_csv:
        known = spacing.read_table(spark, cfg.spacing_csv)
        spacing.require_all(names.join(known, "name", "left"))
        bones = bones.withColumn("name", spacing.base_name(F.col("path"))).join(known, "name").drop("name")
    elif cfg.spacing_dir:
        other = tiff.volumes(spark, tiff.discover(spark, cfg.spacing_dir)).select(spacing.base_name(F.col("path")).alias("name"), own.alias("h_um")).groupBy("name").agg(F.min("h_um").alias("h_um"))
        bones = bones.withColumn("name", spacing.base_name(F.col("path"))).join(other, "name", "left").drop("name")
    else:
        bones = bones.withColumn("h_um", own)
    no_spacing = F.when(~F.coalesce(F.col("h_um") > 0, F.lit(False)), F.lit("no isotropic spacing"))
    bones = bones.select("specimen", "width", "height", "depth", "h_um", F.col("voxels").alias("bone"), F.coalesce("problem", no_spacing).alias("problem"))
    if cfg.roi_dir is None:
        return bones.withColumn("roi", F.lit(None).cast("binary"))
    roi_files = tiff.discover(spark, cfg.roi_dir, cfg.subdirs)
    rel = lambda df, root: df.select(relative(root).alias("specimen"))
    missing = [] if cfg.continue_on_error else rel(files, cfg.binary_dir).join(rel(roi_files, cfg.roi_dir), "specimen", "left_anti").limit(5).collect()
    if missing:
        raise InputError("no region for " + ", ".join(r["specimen"] for r in missing))
    size = lambda: F.struct("width", "height", "depth")
    regions = tiff.volumes(spark, roi_files, 0, "roi").select(relative(cfg.roi_dir).alias("specimen"), size().alias("roi_size"), F.col("voxels").alias("roi"), F.coalesce("problem", F.lit("")).alias("roi_problem"))
    both = bones.join(regions, "specimen", "left")
    why = F.when(F.col("roi_problem").isNull(), "no region").when(F.col("roi_problem") != "", F.concat(F.lit("region: "), "roi_problem")).when(F.col("roi_size") != size(), "region and volume differ in size")
    return both.select("specimen", "width", "height", "depth", "h_um", "bone", "roi", F.coalesce("problem", why).alias("problem"))


def run(spark: SparkSession, cfg: Config, output: str | None = None) -> DataFrame:
    """Result rows under their output names, computed once and kept in the shared folder; also written
    as CSV where ``output`` is given. With ``continue_on_error`` specimens that fail are printed and
    left out."""
    cfg.check()
    rows = cut(report.analyse(load(spark, cfg), cfg.mode, cfg, "keep" if cfg.continue_on_error else "raise"), "rows")
    if cfg.continue_on_error:
        failed = rows.filter("status <> 'OK'").select("specimen", "error")
        for r in failed.orderBy("specimen").limit(MOST_PRINTED).collect():
            print(f"failed: {r['specimen']}: {r['error']}", file=sys.stderr)
        rows = rows.filter("status = 'OK'")
    out = report.named(rows.orderBy("specimen"), mode=cfg.mode, advanced=cfg.advanced, families=cfg.families)
    if output:
        report.write_csv(out, output)
    return out
