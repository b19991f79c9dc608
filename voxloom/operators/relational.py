"""Operators that are plain relational plans: neighbours, ranges, quantiles, edges, axes."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.functions.voxels import ridge_limits
from voxloom.session import cut

OFFSETS6 = [o for o in product((-1, 0, 1), repeat=3) if sum(map(abs, o)) == 1]
OFFSETS26 = [o for o in product((-1, 0, 1), repeat=3) if any(o)]


# Joins of exploded sides ask for a merge join: the planner's size estimate does not count what an
# explode multiplies, so it could broadcast a side that grows with the data.


def offset_rows(offsets: list[tuple[int, int, int]]) -> Column:
    """The offsets as an array literal to explode: a constant, so no join and no shuffle."""
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for a, b, c in offsets]))


def neighbour_pairs(a: DataFrame, b: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Pairs of a voxel of ``a`` and a voxel of ``b`` at one of the offsets: specimen, x, y, z,
    dx, dy, dz. One equi-join on the shifted coordinates."""
    moved = a.select("specimen", "x", "y", "z", offset_rows(offsets).alias("o"))
    moved = moved.select("specimen", "x", "y", "z", "o.dx", "o.dy", "o.dz", *[(F.col(c) + F.col(f"o.d{c}")).alias(f"n{c}") for c in "xyz"])
    other = b.select("specimen", *[F.col(c).alias(f"n{c}") for c in "xyz"])
    return moved.join(other.hint("merge"), ["specimen", "nx", "ny", "nz"]).select("specimen", "x", "y", "z", "dx", "dy", "dz")


def touching(voxels: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Pairs of set voxels of one table at the given offsets and their opposites: specimen, x, y, z, dx,
    dy, dz, the first voxel at x, y, z. Each voxel votes once for each offset at the voxel it may
    meet, one aggregation finds the votes that fell on set voxels, and a found pair counts both
    ways: no join, and one row for each voxel and offset."""
    marks = F.array(F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"), F.lit(0).alias("dz"), F.lit(1).cast("long").alias("bit")), *[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz"), F.lit(2 << k).cast("long").alias("bit")) for k, (a, b, c) in enumerate(offsets)])
    votes = voxels.select("specimen", "x", "y", "z", F.explode(marks).alias("o")).select("specimen", *[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in "xyz"], "o.bit")
    met = votes.groupBy("specimen", "x", "y", "z").agg(F.bit_or("bit").alias("bits")).filter("bits & 1 = 1 AND bits > 1")
    there = F.explode(F.filter(F.array(*[F.struct(F.lit(2 << k).cast("long").alias("bit"), *[F.lit(-v).alias(f"d{c}") for c, v in zip("xyz", o, strict=True)]) for k, o in enumerate(offsets)]), lambda s: F.col("bits").bitwiseAND(s["bit"]) > 0))
    one = met.select("specimen", "x", "y", "z", there.alias("o")).select("specimen", "x", "y", "z", "o.dx", "o.dy", "o.dz")
    ways = F.explode(F.array(F.struct(*[F.col(c).alias(c) for c in ("x", "y", "z", "dx", "dy", "dz")]), F.struct(*[(F.col(c) + F.col(f"d{c}")).alias(c) for c in "xyz"], *[(-F.col(f"d{c}")).alias(f"d{c}") for c in "xyz"])))
    return one.select("specimen", ways.alias("w")).select("specimen", "w.*")


def degree26(voxels: DataFrame) -> DataFrame:
    """Number of set 26-neighbours of each voxel: the sum over its cube, one axis at a time, less
    itself. Each pass sums three rows for each voxel before it shuffles, instead of 27 at once."""
    now = voxels.select("specimen", "x", "y", "z", F.lit(1).cast("long").alias("n"), F.lit(1).alias("own"))
    for axis in "xyz":
        moved = now.select("specimen", *[c for c in "xyz" if c != axis], "n", "own", F.col(axis).alias("at"), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d"))
        moved = moved.withColumn(axis, F.col("at") + F.col("d")).withColumn("own", F.when(F.col("d") == 0, F.col("own")).otherwise(0))
        now = moved.groupBy("specimen", "x", "y", "z").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
    return now.filter("own = 1").select("specimen", "x", "y", "z", (F.col("n") - 1).alias("degree"))


def ridge_table(spark: SparkSession, most: int) -> DataFrame:
    """(r2, t1, t2, t3) for squared radii 1..most, computed by rule."""
    return spark.createDataFrame([(r, *ridge_limits(r)) for r in range(1, most + 1)], "r2 int, t1 int, t2 int, t3 int")


def window_points(seeds: DataFrame, voxels: DataFrame, r: int, tasks: int | None = None) -> DataFrame:
    """Voxels in the cube of radius r around each seed (specimen, seed, sx, sy, sz). Voxels meet
    seeds by blocks of side 2 r + 1, so the join is an equi-join on at most eight blocks a seed and
    does not explode the window. ``tasks`` deals both sides to so many, for tables that grow."""
    side = 2 * r + 1
    blocks = F.explode(F.array(*[F.struct(*[F.floor((F.col(f"s{c}") + s * r) / side).cast("int").alias(f"b{c}") for c, s in zip("xyz", o, strict=True)]) for o in product((-1, 1), repeat=3)]))
    at = seeds.select("specimen", "seed", "sx", "sy", "sz", blocks.alias("b")).select("specimen", "seed", "sx", "sy", "sz", "b.*")
    near = voxels.select("specimen", "x", "y", "z", *[F.floor(F.col(c) / side).cast("int").alias(f"b{c}") for c in "xyz"])
    keys = ["specimen", "bx", "by", "bz"]
    if tasks:
        at, near = at.repartition(tasks, *keys), near.repartition(tasks, *keys)
    inside = at.distinct().join(near.hint("merge"), keys).filter(" AND ".join(f"abs({c} - s{c}) <= {r}" for c in "xyz"))
    return inside.select("specimen", "seed", "x", "y", "z")


def window_moments(seeds: DataFrame, voxels: DataFrame, r: int, tasks: int | None = None) -> DataFrame:
    """Moments of the voxels in each seed's window: count, sums and products, all integers."""
    sums = {"n": F.count("*"), **{f"m{c}": F.sum(c) for c in "xyz"}, **{f"m{a}{b}": F.sum(F.col(a) * F.col(b)) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")}}
    return window_points(seeds, voxels, r, tasks).groupBy("specimen", "seed").agg(*[v.cast("long").alias(k) for k, v in sums.items()])


def radius_pairs(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Rows of a and b of one specimen within a distance: bucketed equi-join. Columns of a carry the
    suffix _a, those of b _b; both have specimen, id, x, y, z."""
    cell = {c: F.floor(F.col(f"{c}") / radius).cast("int") for c in "xyz"}
    left = a.select("specimen", *[F.col(c).alias(f"{c}_a") for c in a.columns if c != "specimen"], *[v.alias(f"c{c}") for c, v in cell.items()])
    spread = offset_rows([*OFFSETS26, (0, 0, 0)])
    right = b.select("specimen", *[F.col(c).alias(f"{c}_b") for c in b.columns if c != "specimen"], *[v.alias(f"k{c}") for c, v in cell.items()], spread.alias("o"))
    right = right.select("*", *[(F.col(f"k{c}") + F.col(f"o.d{c}")).alias(f"c{c}") for c in "xyz"]).drop("o", "kx", "ky", "kz")
    d2 = sum((F.col(f"{c}_a") - F.col(f"{c}_b")) * (F.col(f"{c}_a") - F.col(f"{c}_b")) for c in "xyz")
    return left.join(right.hint("merge"), ["specimen", "cx", "cy", "cz"]).filter(d2 <= radius * radius).drop("cx", "cy", "cz")


def grid_representatives(points: DataFrame, cell_um: float, h_um: float) -> DataFrame:
    """The point nearest its cell's centre in each cell, ties by z, y, x: the smallest struct, so
    rows are combined before the shuffle and no window sorts them."""
    scaled = {c: (F.col(c) + 0.5) * h_um / cell_um for c in "xyz"}
    cells = {f"c{c}": F.floor(v).cast("int") for c, v in scaled.items()}
    off = {c: (scaled[c] - cells[f"c{c}"] - 0.5) * cell_um for c in "xyz"}  # as the kernel rounds it, so ties are the same
    d2 = off["x"] * off["x"] + off["y"] * off["y"] + off["z"] * off["z"]
    best = points.select("specimen", *[v.alias(k) for k, v in cells.items()], F.struct(d2.alias("d2"), "z", "y", "x").alias("p"))
    return best.groupBy("specimen", "cx", "cy", "cz").agg(F.min("p").alias("p")).select("specimen", "cx", "cy", "cz", "p.x", "p.y", "p.z", "p.d2")


# --- distributions -------------------------------------------------------------------------------


def running(values: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Rows of distinct values of a group with ``upto``, the weight of all values up to the row's, the
    group's ``total``, and ``before``, the next smaller value (null for the smallest).

    A group may hold more rows than a task: rows are dealt by ranges of value, each range sums its
    own, and a table of one row for each group and range tells what lies before it. The ranges are
    written to the shared folder, so both readers see the same ones.
    """
    dealt = cut(values.repartitionByRange(*[F.col(c) for c in by], F.col(value)).withColumn("piece", F.spark_partition_id()), "ranges")
    pieces = dealt.groupBy(*by, "piece").agg(F.sum(weight).alias("held"), F.max(value).alias("last"))
    order = Window.partitionBy(*by).orderBy("piece")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    known = pieces.select(*by, "piece", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"), F.sum("held").over(Window.partitionBy(*by)).alias("total"), F.max("last").over(ahead).alias("last"))
    inside = Window.partitionBy(*by, "piece").orderBy(value)
    own = dealt.select("*", F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("own"), F.lag(value).over(inside).alias("beside"))
    joined = own.join(known, [*by, "piece"])
    return joined.select(*by, value, weight, (F.col("ahead") + F.col("own")).alias("upto"), "total", F.coalesce("beside", "last").alias("before"))


def weighted_quantiles(df: DataFrame, by: list[str], value: str, weight: str, qs: tuple[float, ...]) -> DataFrame:
    """Quantiles by interpolation over the share of weight up to and with each value. Equal values
    are summed first."""
    v = df.groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.sum(F.col(weight).cast("double")).alias("w"))
    run = running(v, by, "v", "w").select(*by, "v", (F.col("upto") / F.col("total")).alias("share"), F.col("before").alias("v0"), ((F.col("upto") - F.col("w")) / F.col("total")).alias("s0"))
    cuts = run.select(*by, "v", "share", "v0", "s0", F.explode(F.array(*[F.lit(q) for q in qs])).alias("q")).filter((F.col("share") >= F.col("q")) & (F.col("v0").isNull() | (F.col("s0") < F.col("q"))))
    at = F.when(F.col("v0").isNull(), F.col("v")).otherwise(F.col("v0") + (F.col("v") - F.col("v0")) * (F.col("q") - F.col("s0")) / (F.col("share") - F.col("s0")))
    return cuts.select(*by, "q", at.alias("value"))


def quantiles(df: DataFrame, by: list[str], value: str, qs: tuple[float, ...]) -> DataFrame:
    """(by, q, value): quantiles by interpolation between the two nearest ranks; nulls and NaN do not count.
    Equal values are counted first, ranks come from running sums over ranges of values."""
    v = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("k"))
    place = F.col("q") * (F.col("total") - 1)
    low = F.floor(place)
    held = lambda rank: (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("k"))
    at = running(v, by, "v", "k").select(*by, "v", "k", "upto", "total", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    share = F.when(held(low), 1 - (place - low)).otherwise(0.0) + F.when(held(low + 1), place - low).otherwise(0.0)
    return at.withColumn("share", share).filter(held(low) | held(low + 1)).groupBy(*by, "q").agg(F.sum(F.col("v") * F.col("share")).alias("value"))


def gini(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Gini coefficient of each group; null, NaN and negative values count as 0."""
    x = F.when(F.isnan(value) | (F.col(value) <= 0), 0.0).otherwise(F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    counted = df.groupBy(*by, x.alias("x")).agg(F.count("*").alias("k"))
    # ranks of equal values sum to k * (first + last) / 2
    part = running(counted, by, "x", "k").withColumn("ranks", F.col("k") * (2 * F.col("upto") - F.col("k") + 1) / 2.0)
    n, total = F.sum("k"), F.sum(F.col("k") * F.col("x"))
    value_ = F.when(total <= 0, 0.0).otherwise(2 * F.sum(F.col("ranks") * F.col("x")) / (n * total) - (n + 1) / n)
    return part.groupBy(*by).agg(n.alias("n"), value_.alias("gini"))


def repetition_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for one), coefficient of variation, range."""
    v = F.col(value)
    sd = F.coalesce(F.stddev_samp(v), F.lit(0.0))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), sd.alias("sd"), F.when(F.avg(v) != 0, F.abs(sd / F.avg(v))).alias("cv"), F.min(v).alias("low"), F.max(v).alias("high"))


def collapse_edges(edges: DataFrame, by: list[str]) -> DataFrame:
    """Simple graph of a multigraph (u, v, length): multiplicity, shortest length, conductance.
    Loops go; edges of length 0 conduct nothing."""
    return (
        edges.filter("u <> v")
        .groupBy(*by, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .agg(F.count("*").alias("multiplicity"), F.min("length").alias("length"), F.sum(F.when(F.col("length") > 0, 1.0 / F.col("length")).otherwise(0.0)).alias("conductance"))
    )


def curvature_summary(df: DataFrame, by: list[str], h: str, k: str, w: str) -> DataFrame:
    H, K, W = F.col(h), F.col(k), F.col(w)
    total = F.sum(W)
    mean = F.sum(W * H) / total
    share = lambda c: F.sum(F.when(c, W).otherwise(0.0)) / total
    return df.groupBy(*by).agg(
        mean.alias("h_mean"), F.sqrt(F.greatest(F.sum(W * H * H) / total - mean * mean, F.lit(0.0))).alias("h_sd"), (F.sum(W * F.abs(H)) / total).alias("h_abs_mean"),
        share(K < 0).alias("saddle"), share((K >= 0) & (H >= 0)).alias("convex"), share((K >= 0) & (H < 0)).alias("concave"), share(H * H - K < 0).alias("negative_discriminant"),
    )


# --- geometry columns ----------------------------------------------------------------------------


def unit(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    n = F.sqrt(x * x + y * y + z * z)
    return x / n, y / n, z / n


def axis_sign(x: Column, y: Column, z: Column) -> Column:
    """1 or -1, so that the first of z, y, x that differs from 0 becomes positive."""
    side = lambda c: F.when(c > 0, 1).otherwise(-1)
    return F.when(F.abs(z) > 1e-15, side(z)).when(F.abs(y) > 1e-15, side(y)).when(F.abs(x) > 1e-15, side(x)).otherwise(1)


def axis_angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """theta in (-pi/2, pi/2], phi in [0, pi/2] of an unoriented unit axis."""
    s = axis_sign(x, y, z)
    theta = F.pmod(F.atan2(s * y, s * x) + math.pi / 2, F.lit(math.pi)) - math.pi / 2
    theta = F.when(F.abs(theta + math.pi / 2) <= 1e-14 + 1e-5 * math.pi / 2, math.pi / 2).otherwise(theta)
    return theta, F.acos(F.least(F.abs(z), F.lit(1.0)))


def axis_angle_deg(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.degrees(F.acos(F.least(F.abs(sum(p * q for p, q in zip(a, b, strict=True))), F.lit(1.0))))


def ray_box(point: list[Column], direction: list[Column], low: float, high: float) -> tuple[Column, Column]:
    """Entry and exit of a line through a cube; null where it misses or the cube lies behind."""
    ends = [((low - p) / d, (high - p) / d) for p, d in zip(point, direction, strict=True)]
    near = F.greatest(*[F.least(a, b) for a, b in ends])
    far = F.least(*[F.greatest(a, b) for a, b in ends])
    hit = (near <= far) & (far >= 0)
    return F.when(hit, near), F.when(hit, far)
