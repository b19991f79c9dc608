"""Volumes derived from the tables: each part is a ball, forty parts in a row are a specimen."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.specimens import VOLUME_SCHEMA

N, PARTS, H_UM = 24, 40, 25.0
WIDE_PARTS = 120


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls_of(table(spark, sf_dir, "part"))


def balls_of(parts: DataFrame) -> DataFrame:
    """specimen, cx, cy, cz, r of rows p_partkey, p_size: narrow, two columns of the scan."""
    at = lambda m, a: ((F.col("p_partkey") * m + a) % N).cast("int")
    return parts.select(
        F.floor(F.col("p_partkey") / float(PARTS)).cast("int").alias("specimen"),
        F.col("p_partkey").alias("ball"),
        at(7919, 13).alias("cx"), at(104729, 7).alias("cy"), at(1299709, 3).alias("cz"),
        (2 + F.col("p_size") % 3).cast("int").alias("r"),
    )


#: Specimens that a task of a voxel query holds.
TASK_SPECIMENS = 100


def tasks_of(parts: DataFrame, each: int = PARTS) -> int:
    """Tasks for specimens of ``each`` parts: the session's shuffle partitions, or more where a task would hold more
    than TASK_SPECIMENS, so that tasks stay as small as they are when tables grow. One count, which the
    footers of Parquet files answer."""
    return max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() // (each * TASK_SPECIMENS)))


def dealt(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows dealt by specimen before they become many: aggregations by specimen and more move nothing again."""
    return rows.repartition(tasks_of(parts), "specimen")


def in_disc(x: Column, y: Column) -> Column:
    return (2 * x - 23) * (2 * x - 23) + (2 * y - 23) * (2 * y - 23) <= 484


def solid_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of the balls, before the region: specimen, x, y, z. Each ball is exploded over its
    own cube where its specimen is, and one distinct there removes overlaps."""
    span = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - F.col("r")), F.least(F.lit(N - 1), F.col(c) + F.col("r"))))
    sq = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    return (
        dealt(balls(spark, sf_dir), table(spark, sf_dir, "part"))
        .withColumn("x", span("cx"))
        .withColumn("y", span("cy"))
        .filter(sq("x", "cx") + sq("y", "cy") <= F.col("r") * F.col("r"))
        .withColumn("z", span("cz"))
        .filter(sq("x", "cx") + sq("y", "cy") + sq("z", "cz") <= F.col("r") * F.col("r"))
        .select("specimen", "x", "y", "z")
        .distinct()
    )


def bone_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bone inside the region. The region's predicate is pushed below the distinct."""
    return solid_voxels(spark, sf_dir).filter(in_disc(F.col("x"), F.col("y")))


def paint(centres: list[tuple[int, int, int, int]], n: int = N) -> np.ndarray:
    g = np.arange(n)
    out = np.zeros((n, n, n), bool)
    for cx, cy, cz, r in centres:
        lo, hi = [max(0, c - r) for c in (cz, cy, cx)], [min(n, c + r + 1) for c in (cz, cy, cx)]
        z, y, x = (g[a:b] - c for a, b, c in zip(lo, hi, (cz, cy, cx), strict=True))
        out[lo[0] : hi[0], lo[1] : hi[1], lo[2] : hi[2]] |= z[:, None, None] ** 2 + y[:, None] ** 2 + x**2 <= r * r
    return out


def region(n: int = N) -> np.ndarray:
    g = (2 * np.arange(n) - (n - 1)) ** 2
    return np.broadcast_to(g[:, None] + g[None, :] <= (n - 2) ** 2, (n, n, n)).copy()


#: Voxels of the region of a specimen of N voxels a side.
REGION_VOXELS = int(region().sum())


def volumes(spark: SparkSession, sf_dir: str, n: int = N, parts: int = PARTS, wide: bool = False) -> DataFrame:
    """One row for each specimen in the operators' volume form. ``wide`` makes larger
    specimens of more parts, for measures that need room around them."""
    found = balls(spark, sf_dir)
    if wide:
        at = lambda m, a: ((F.col("p_partkey") * m + a) % n).cast("int")
        found = table(spark, sf_dir, "part").select(
            F.floor(F.col("p_partkey") / float(WIDE_PARTS)).cast("int").alias("specimen"), F.col("p_partkey").alias("ball"), at(7919, 13).alias("cx"), at(104729, 7).alias("cy"), at(1299709, 3).alias("cz"), (5 + F.col("p_size") % 5).cast("int").alias("r")
        )
    return volumes_of(found, n)


def volumes_of(found: DataFrame, n: int = N) -> DataFrame:
    """Specimens of n voxels a side, painted from rows specimen, ball, cx, cy, cz, r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roi = region(n)
        for b in batches:
            d = b.to_pydict()
            for specimen, found in zip(d["specimen"], d["balls"], strict=True):
                bone = paint([(c["cx"], c["cy"], c["cz"], c["r"]) for c in found], n)
                yield pa.RecordBatch.from_pydict({"specimen": [specimen], "width": [n], "height": [n], "depth": [n], "h_um": [H_UM], "bone": [np.packbits(bone).tobytes()], "roi": [np.packbits(roi).tobytes()]}, schema=VOLUME_SCHEMA(pa.int32()))

    # few bytes here become much work: without a number, adaptive execution would make one task of it
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = found.repartition(tasks, "specimen").groupBy("specimen").agg(F.sort_array(F.collect_list(F.struct("ball", "cx", "cy", "cz", "r"))).alias("balls"))
    return held.mapInArrow(run, "specimen int, width int, height int, depth int, h_um double, bone binary, roi binary")


#: Cells of the wire fixture: 4 x 6 places, a figure in each.
WIRE_X, WIRE_Y = 4, 6


def wire_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """specimen, x0, y0, z0, kind, length: the figure of each cell, from the cell's first part. Kinds:
    0 straight line from top to bottom, 1 zigzag, 2 short line, 3 line with an arm, 4 ring of four."""
    k = F.col("p_partkey")
    cell = ((k * 7919 + 13) % (WIRE_X * WIRE_Y)).cast("int")
    parts = table(spark, sf_dir, "part").select(F.floor(k / float(PARTS)).cast("int").alias("specimen"), cell.alias("cell"), F.struct(k, (F.col("p_size") % 5).cast("int").alias("kind")).alias("part"))
    first = parts.groupBy("specimen", "cell").agg(F.min("part").alias("part"))
    key, c = F.col("part.p_partkey"), F.col("cell")
    return first.select(
        "specimen", (6 * (c % WIRE_X) + 1).alias("x0"), (4 * F.floor(c / float(WIRE_X)) + 1).cast("int").alias("y0"), (3 + (key * 104729 + 7) % 18).cast("int").alias("z0"),
        F.col("part.kind").alias("kind"), (2 + key % 15).cast("int").alias("length"),
    )


def draw_wire(v: np.ndarray, x: int, y: int, z: int, kind: int, length: int) -> None:
    """Set the voxels of one figure in an array [z, y, x]."""
    if kind in (0, 3):
        v[:, y, x] = True
    if kind == 1:
        v[::2, y, x] = v[1::2, y, x + 1] = True
    if kind == 2:
        v[3 : 3 + length, y, x] = True
    if kind == 3:
        v[z, y, x + 1 : x + 4] = True
    if kind == 4:
        v[z, [y, y + 1, y, y - 1], [x, x + 1, x + 2, x + 1]] = True


def wires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specimens of thin figures that their skeletons repeat, all connected ones from top to bottom or
    within; the region is the whole image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                bone = np.zeros((N, N, N), bool)
                for f in row["figures"]:
                    draw_wire(bone, f["x0"], f["y0"], f["z0"], f["kind"], f["length"])
                yield pa.RecordBatch.from_pydict({"specimen": [row["specimen"]], "width": [N], "height": [N], "depth": [N], "h_um": [H_UM], "bone": [np.packbits(bone).tobytes()], "roi": [None]}, schema=VOLUME_SCHEMA(pa.int32()))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = wire_figures(spark, sf_dir).repartition(tasks, "specimen").groupBy("specimen").agg(F.collect_list(F.struct("x0", "y0", "z0", "kind", "length")).alias("figures"))
    return held.mapInArrow(run, "specimen int, width int, height int, depth int, h_um double, bone binary, roi binary")


FOAM_N, FOAM_PARTS = 48, 80


def draw_element(v: np.ndarray, centre: tuple[int, int, int], axis: tuple[int, int, int], plate: bool) -> None:
    """A plate (a disc of radius 10 and thickness 3) or a rod (radius 1.5, length 40) across its centre."""
    u = np.array(axis, float) / np.linalg.norm(axis)
    reach = 11 if plate else 21  # nothing of an element is farther from its centre
    box = tuple(slice(max(0, c - reach), c + reach + 1) for c in centre[::-1])
    z, y, x = (np.arange(n, dtype=np.float64)[k] - c for n, k, c in zip(v.shape, box, centre[::-1], strict=True))
    z, y = z[:, None, None], y[:, None]
    along = x * u[0] + y * u[1] + z * u[2]
    across = x * x + y * y + z * z - along * along
    v[box] |= (np.abs(along) <= 1.5) & (across <= 100) if plate else (np.abs(along) <= 20) & (across <= 2.25)


def foam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected specimens of 48 voxels a side with many plates and rods, one for each run of 80 parts:
    even sizes are plates, odd ones rods. The region is the whole image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                bone = np.zeros((FOAM_N,) * 3, bool)
                for e in row["elements"]:
                    draw_element(bone, (e["cx"], e["cy"], e["cz"]), (e["ux"], e["uy"], e["uz"]), e["plate"])
                yield pa.RecordBatch.from_pydict({"specimen": [row["specimen"]], "width": [FOAM_N], "height": [FOAM_N], "depth": [FOAM_N], "h_um": [H_UM], "bone": [np.packbits(bone).tobytes()], "roi": [None]}, schema=VOLUME_SCHEMA(pa.int32()))

    k = F.col("p_partkey")
    at = lambda m, a, n: ((k * m + a) % n).cast("int")
    element = F.struct(k, at(7919, 13, FOAM_N).alias("cx"), at(104729, 7, FOAM_N).alias("cy"), at(1299709, 3, FOAM_N).alias("cz"), (at(31, 5, 7) - 3).alias("ux"), (at(57, 2, 9) - 4).alias("uy"), (at(13, 4, 5) + 1).alias("uz"), (F.col("p_size") % 2 == 0).alias("plate"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = table(spark, sf_dir, "part").select(F.floor(k / float(FOAM_PARTS)).cast("int").alias("specimen"), element.alias("element"))
    held = parts.repartition(tasks, "specimen").groupBy("specimen").agg(F.sort_array(F.collect_list("element")).alias("elements"))
    return held.mapInArrow(run, "specimen int, width int, height int, depth int, h_um double, bone binary, roi binary")
