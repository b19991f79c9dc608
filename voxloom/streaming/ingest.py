"""Volumes measured as their files arrive: a file stream, one checkpointed batch after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxloom.operators import report
from voxloom.plans.job import relative
from voxloom.session import Config
from voxloom.sources import spacing, tiff

_FILES = "path string, modificationTime timestamp, length long, content binary"


def measure_stream(spark: SparkSession, folder: str, output: str, checkpoint: str, cfg: Config, files_per_batch: int = 64, once: bool = True) -> StreamingQuery:
    """Measure new TIFF files below a folder and append their rows as Parquet.

    A specimen is a file, named by its path below the folder. Each micro-batch writes to a folder of its
    own number and replaces it when it is repeated, so a restart neither loses nor doubles a
    specimen. Regions are the whole images; files that cannot be read give rows with status FAIL.
    """

    def batch(files: DataFrame, number: int) -> None:
        own = F.when(spacing.isotropy(F.col("x_um"), F.col("y_um"), F.col("z_um")).isNull(), F.col("x_um"))
        h = F.lit(float(cfg.voxel_size)) if cfg.voxel_size is not None else own
        found = tiff.decode_volumes(files, cfg.threshold, "strict" if cfg.strict else "any").withColumn("h_um", h)
        why = F.coalesce("problem", F.when(~F.coalesce(F.col("h_um") > 0, F.lit(False)), F.lit("no isotropic spacing")))
        volumes = found.select(relative(folder).alias("specimen"), "width", "height", "depth", "h_um", F.col("voxels").alias("bone"), F.lit(None).cast("binary").alias("roi"), why.alias("problem"))
        report.analyse(volumes, cfg.mode, cfg, "keep").write.mode("overwrite").parquet(f"{output}/batch={number}")

    stream = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][iI][fF]*").option("maxFilesPerTrigger", files_per_batch).load(folder)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
