"""Queries of the morphometry operators, by name, with their SQL for DuckDB."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import intercepts, shape, thinning
from voxloom.operators import measures as M
from voxloom.operators import parity
from voxloom.operators import relational as R
from voxloom.operators import report
from voxloom.operators import slabs as SL
from voxloom.plans import fixtures as X
from voxloom.plans import oracle_lines
from voxloom.plans.oracles import ORACLES
from voxloom.session import Config
from voxloom.sources import spacing as S
from voxloom.sources import tiff

Query = Callable[[SparkSession, str], DataFrame]


def _round(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in df.columns])


def _topology(*cols: str, **digits: int) -> Query:
    """A projection of the topology kernel: one pass over the volumes."""
    return lambda s, d: _round(M.run(X.volumes(s, d), M.topology, M.TOPOLOGY, "omit").select("specimen", *cols), **digits)


def _kernel(kernel, schema: str, *cols: str, on_error: str = "keep", **digits: int) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        df = M.run(X.volumes(s, d), kernel, schema, on_error)
        return _round(df.select("specimen", *cols) if cols else df, **digits)

    return query


def _wires(kernel, schema: str, *cols: str, on_error: str = "keep", **digits: int) -> Query:
    """A kernel on the figures whose skeletons are known."""

    def query(s: SparkSession, d: str) -> DataFrame:
        df = M.run(X.wires(s, d), kernel, schema, on_error)
        return _round(df.select("specimen", *cols) if cols else df, **digits)

    return query


def bv_tv(s: SparkSession, d: str) -> DataFrame:
    n = X.bone_voxels(s, d).groupBy("specimen").agg(F.count("*").alias("bone_voxels"))
    return n.select("specimen", "bone_voxels", F.lit(X.REGION_VOXELS).cast("long").alias("tv_voxels"), F.round(F.col("bone_voxels") / float(X.REGION_VOXELS), 9).alias("bv_tv"))


def phase_inside(s: SparkSession, d: str) -> DataFrame:
    inside = F.count_if(X.in_disc(F.col("x"), F.col("y")))
    return X.solid_voxels(s, d).groupBy("specimen").agg(F.count("*").alias("solid"), inside.alias("inside"), (X.REGION_VOXELS - inside).alias("marrow"))


def neighbours6(s: SparkSession, d: str) -> DataFrame:
    return R.touching(X.bone_voxels(s, d), R.OFFSETS6[3:]).groupBy("specimen", "dx", "dy", "dz").agg(F.count("*").alias("pairs"))


def degree26(s: SparkSession, d: str) -> DataFrame:
    return R.degree26(X.bone_voxels(s, d)).groupBy("specimen", "degree").agg(F.count("*").alias("voxels"))


def ridge_templates(s: SparkSession, d: str) -> DataFrame:
    return R.ridge_table(s, 100)


def euler_lut(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(thinning.euler_table(), "config int, contribution int")


def _seeds(s: SparkSession, d: str) -> DataFrame:
    return X.dealt(X.balls(s, d), X.table(s, d, "part")).select("specimen", F.col("ball").alias("seed"), F.col("cx").alias("sx"), F.col("cy").alias("sy"), F.col("cz").alias("sz"))


def window_points(s: SparkSession, d: str) -> DataFrame:
    return R.window_points(_seeds(s, d), X.bone_voxels(s, d), 4, X.tasks_of(X.table(s, d, "part")))


def window_moments(s: SparkSession, d: str) -> DataFrame:
    return R.window_moments(_seeds(s, d), X.bone_voxels(s, d), 4, X.tasks_of(X.table(s, d, "part")))


def grid_representatives(s: SparkSession, d: str) -> DataFrame:
    return R.grid_representatives(X.bone_voxels(s, d), 100.0, 25.0).select("specimen", "x", "y", "z")


def _axes(s: SparkSession, d: str) -> DataFrame:
    u = R.unit(*[F.col(f"c{c}") - 11.5 for c in "xyz"])
    return X.balls(s, d).select("specimen", F.col("ball").alias("id"), "r", *[F.col(f"c{c}").alias(c) for c in "xyz"], *[v.alias(f"u{c}") for c, v in zip("xyz", u, strict=True)])


def _pair_angle(kind: str):
    dot = F.least(F.abs(sum(F.col(f"u{c}_a") * F.col(f"u{c}_b") for c in "xyz")), F.lit(1.0))
    return F.degrees(F.acos(dot) if kind == "same" else F.asin(dot))


def misorientation(s: SparkSession, d: str) -> DataFrame:
    a = _axes(s, d)
    local = R.radius_pairs(a, a, 8.0).filter("id_a <> id_b").groupBy("specimen", "id_a").agg(F.avg(_pair_angle("same")).alias("m"))
    return local.groupBy("specimen").agg(F.round(F.avg("m"), 3).alias("misorientation"), F.count("*").alias("centers"))


def orthogonality(s: SparkSession, d: str) -> DataFrame:
    a = _axes(s, d)
    pairs = R.radius_pairs(a.filter("r = 2"), a.filter("r > 2"), 8.0).select("specimen", "id_a", "id_b", _pair_angle("cross").alias("m"))
    side = lambda k: pairs.groupBy("specimen", k).agg(F.avg("m").alias("m")).groupBy("specimen").agg(F.avg("m").alias(k))
    return side("id_a").join(side("id_b"), "specimen").select("specimen", F.round(0.5 * (F.col("id_a") + F.col("id_b")), 3).alias("deviation"))


def da_domain(s: SparkSession, d: str) -> DataFrame:
    """The centred square of every specimen's region in which intercepts are sampled."""

    def kernel(bone, roi, h) -> dict:
        return dict(zip(("x0", "y0", "side"), intercepts.domain(roi), strict=True))

    return M.run(X.volumes(s, d), kernel, "x0 int, y0 int, side int", "omit")


def weighted_quantile(s: SparkSession, d: str) -> DataFrame:
    return _round(R.weighted_quantiles(X.table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", (0.1, 0.5, 0.9)), value=4)


def gini(s: SparkSession, d: str) -> DataFrame:
    return _round(R.gini(X.table(s, d, "orders"), ["o_orderpriority"], "o_totalprice"), gini=9)


def rep_summary(s: SparkSession, d: str) -> DataFrame:
    return _round(R.repetition_summary(X.table(s, d, "lineitem"), ["l_suppkey"], "l_extendedprice"), mean=4, sd=4, cv=6)


def convergence_summary(s: SparkSession, d: str) -> DataFrame:
    return _round(parity.run_summary(X.table(s, d, "orders").withColumn("ok", F.col("o_orderstatus") == "F"), ["o_orderpriority"], "o_totalprice"), mean=4, sd=4, cv=6)


def collapsed_edges(s: SparkSession, d: str) -> DataFrame:
    e = X.table(s, d, "lineitem").select((F.col("l_suppkey") % 40).cast("int").alias("u"), (F.col("l_partkey") % 40).cast("int").alias("v"), F.col("l_quantity").alias("length"))
    return _round(R.collapse_edges(e, []), conductance=6)


def curvature_summary(s: SparkSession, d: str) -> DataFrame:
    c = X.table(s, d, "lineitem").select("l_linestatus", (F.col("l_discount") - 0.05).alias("h"), ((F.col("l_tax") - 0.04) * 0.01).alias("k"), F.col("l_quantity").alias("w"))
    out = R.curvature_summary(c, ["l_linestatus"], "h", "k", "w")
    return _round(out, **dict.fromkeys(out.columns[1:], 6))


def canonical_axis(s: SparkSession, d: str) -> DataFrame:
    u = [F.col(f"u{c}") for c in "xyz"]
    k = R.axis_sign(*u)
    return _axes(s, d).select(F.col("id").alias("ball"), *[F.round(k * v, 9).alias(c) for c, v in zip("xyz", u, strict=True)])


def axis_angles(s: SparkSession, d: str) -> DataFrame:
    theta, phi = R.axis_angles(*[F.col(f"u{c}") for c in "xyz"])
    return _axes(s, d).select(F.col("id").alias("ball"), F.round(theta, 9).alias("theta"), F.round(phi, 9).alias("phi"))


def axis_angle(s: SparkSession, d: str) -> DataFrame:
    a = _axes(s, d).select(F.col("id").alias("ball"), *[F.col(f"u{c}").alias(f"a{c}") for c in "xyz"])
    b = _axes(s, d).select((F.col("id") - 1).alias("ball"), *[F.col(f"u{c}").alias(f"b{c}") for c in "xyz"])
    angle = R.axis_angle_deg([F.col(f"a{c}") for c in "xyz"], [F.col(f"b{c}") for c in "xyz"])
    return a.join(b, "ball").select("ball", F.round(angle, 6).alias("angle"))


def ray_box(s: SparkSession, d: str) -> DataFrame:
    near, far = R.ray_box([F.col("cx") - 30.0, F.col("cy") + 0.25, F.col("cz") + 0.25], [F.lit(1.0), (F.col("r") - 2.5) / 4, (F.col("r") - 3.25) / 4], 0.0, 24.0)
    return X.balls(s, d).select("ball", F.round(near, 9).alias("entry"), F.round(far, 9).alias("leave"))


def splitmix64(s: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("long")
    def draw(seed: pd.Series) -> pd.Series:
        return pd.Series((intercepts.first_draws(seed.to_numpy()) >> np.uint64(11)).astype(np.int64))

    return X.table(s, d, "part").select(F.col("p_partkey").alias("seed"), draw("p_partkey").alias("draw"))


def unit_scale(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(u) for u in (" nm", "Micron", "mm ", "CM", "in", "parsec")])
    return X.table(s, d, "part").select("p_partkey", S.unit_scale(names[(F.col("p_partkey") % 6).cast("int")]).alias("um"))


def spacing_isotropy(s: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    x = F.when(n % 7 == 0, 0.0).otherwise(25.0)
    y = F.when((n % 7 != 0) & (n % 5 == 0), 26.0).otherwise(25.0)
    z = F.when((n % 7 != 0) & (n % 5 != 0) & (n % 3 == 0), 25.001).otherwise(25.0)
    return X.table(s, d, "part").select("p_partkey", S.isotropy(x, y, z).alias("problem"))


def spacing_table(s: SparkSession, d: str) -> DataFrame:
    rows = X.table(s, d, "supplier").select(F.concat(F.lit(" scans/"), "s_name", F.lit(" ")).alias("filename"), (20.0 + F.col("s_suppkey") % 6).alias("spacing_micrometers"), (F.col("s_suppkey") % 5 == 0).alias("twice"))
    return S.checked_table(rows.unionByName(rows.filter("twice")))


def spacing_join(s: SparkSession, d: str) -> DataFrame:
    sup = X.table(s, d, "supplier")
    known = S.checked_table(sup.filter("s_suppkey % 4 <> 0").select(F.upper("s_name").alias("filename"), (20.0 + F.col("s_suppkey") % 6).alias("spacing_micrometers"))).select("name", "h_um")
    return S.attach(sup.select(F.col("s_name").alias("path")), known).select(F.col("path").alias("filename"), "h_um")


def roi_match(s: SparkSession, d: str) -> DataFrame:
    sup = X.table(s, d, "supplier")
    found = report.match_regions(sup.select(F.concat(F.lit("bone/"), "s_name").alias("path")), sup.filter("s_suppkey % 4 <> 0").select(F.concat(F.lit("roi/"), "s_name").alias("path")), "bone/", "roi/")
    return found.agg(F.count("roi_path").alias("matched"), F.count_if(F.col("roi_path").isNull()).alias("missing"))


def specimen_code(s: SparkSession, d: str) -> DataFrame:
    return X.table(s, d, "supplier").select("s_suppkey", S.specimen_code(F.concat(F.lit("x/"), "s_name", F.lit("_roi_mask.TIF"))).alias("code"))


def input_qc(s: SparkSession, d: str) -> DataFrame:
    n = X.solid_voxels(s, d).groupBy("specimen").agg(F.count("*").alias("foreground"))
    return report.input_qc(n.withColumn("background", X.N**3 - F.col("foreground")).withColumn("h_um", F.lit(25.0)))


def _two_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # codes have three digits: each thousand of suppliers uses them again
    sup = X.table(s, d, "supplier").withColumn("batch", F.floor(F.col("s_suppkey") / 1000.0))
    name = F.concat(F.lit("scan_qc"), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"), F.lit(".tif"))
    ours = sup.select("batch", name.alias("filename"), F.col("s_acctbal").alias("v"))
    theirs = sup.select("batch", name.alias("filename"), F.when(F.col("s_suppkey") % 10 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal") + 1e-9).alias("v"))
    return ours, theirs


def parity_report(s: SparkSession, d: str) -> DataFrame:
    return parity.compare(*_two_tables(s, d), ["v"], by=("batch",)).select("code", "pass")


def parity_differences(s: SparkSession, d: str) -> DataFrame:
    found = parity.differences(*_two_tables(s, d), ["v"], by=("batch",))
    return _round(found, max_abs=9, max_rel=9)


def tiff_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Volumes written as TIFF bytes and read back page by page."""
    from voxloom.operators.specimens import per_specimen

    def kernel(bone, roi, h) -> dict:
        data = tiff.write(bone, h)
        found = list(tiff.read_pages(data, 0, "strict"))
        same = all(found[z][6] == np.packbits(bone[z]).tobytes() for z in range(len(bone)))
        return {"pages": len(found), "bytes": len(data), "h": tiff.isotropic(*found[0][3:6]), "same": same}

    return per_specimen(X.volumes(s, d), kernel, "pages long, bytes long, h double, same boolean")


def wide(kernel, schema: str) -> Query:
    """A measure that needs room: specimens of 64 voxels a side, of 120 parts each."""
    return lambda s, d: M.run(X.volumes(s, d, 64, wide=True), kernel, schema)


def degree_of_anisotropy(s: SparkSession, d: str) -> DataFrame:
    return M.anisotropy(X.volumes(s, d))


def quadric_fit(s: SparkSession, d: str) -> DataFrame:
    return M.anisotropy_repetitions(X.volumes(s, d))


_FEW = {"directions": oracle_lines.DIRECTIONS, "lines": oracle_lines.LINES, "repetitions": oracle_lines.REPETITIONS}


def quadric_fit_few(s: SparkSession, d: str) -> DataFrame:
    """Fits of so few lines that SQL can follow their draws; repetitions without an ellipsoid are left out."""
    found = M.anisotropy_repetitions(X.volumes(s, d), **_FEW).filter("status = 'OK'")
    return _round(found.select("specimen", "rep", "da", "angle_deg", "radius_a", "radius_b", "radius_c"), da=6, angle_deg=3, radius_a=5, radius_b=5, radius_c=4)


def degree_of_anisotropy_few(s: SparkSession, d: str) -> DataFrame:
    found = M.anisotropy(X.volumes(s, d), **_FEW)
    return _round(found.select("specimen", "repetitions", "da_mean", "da_sd", "da_min", "da_max", "angle_mean"), da_mean=6, da_sd=6, da_min=6, da_max=6, angle_mean=3)


def eigh3(s: SparkSession, d: str) -> DataFrame:
    """Ascending eigenvalues of the window covariances: moments by SQL, eigenvalues of whole Arrow
    batches at once."""
    m = window_moments(s, d).filter("n > 1")
    mean = {c: F.col(f"m{c}") / F.col("n") for c in "xyz"}
    cov = [((F.col(f"m{a}{b}") - F.col("n") * mean[a] * mean[b]) / (F.col("n") - 1)).alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]

    @F.pandas_udf("array<double>")
    def eigenvalues(xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, xz: pd.Series, yz: pd.Series) -> pd.Series:
        t = np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]).transpose(2, 0, 1)
        return pd.Series(list(np.linalg.eigvalsh(t)))

    e = eigenvalues("xx", "yy", "zz", "xy", "xz", "yz")
    return m.select("specimen", "seed", *cov).withColumn("e", e).select("specimen", "seed", *[F.round(F.col("e")[i], 6).alias(f"e{i + 1}") for i in range(3)])


def orientation_kde(s: SparkSession, d: str) -> DataFrame:
    """Density of every specimen's axes on a coarse grid of 5 degrees, both axes reflected at their
    ends, in built-in functions. ``orientation_density`` has the grid of 0.5 degrees."""
    theta, phi = R.axis_angles(*[F.col(f"u{c}") for c in "xyz"])
    at = _axes(s, d).select("specimen", theta.alias("t"), phi.alias("p"))
    bw = math.radians(4.5)

    def side(g, v, lo: float, hi: float):
        bell = lambda x: F.exp(-0.5 * ((g - x) / bw) * ((g - x) / bw))
        return bell(v) + bell(2 * lo - v) + bell(2 * hi - v)

    steps = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    cells = X.dealt(at, X.table(s, d, "part")).select("specimen", "t", "p", steps(36).alias("i")).select("specimen", "t", "p", "i", steps(18).alias("j"))
    a = side(F.radians(5.0 * F.col("i")) - math.pi / 2, F.col("t"), -math.pi / 2, math.pi / 2)
    b = side(F.radians(5.0 * F.col("j")), F.col("p"), 0.0, math.pi / 2)
    return cells.groupBy("specimen", "i", "j").agg(F.round(F.sum(a * b) / (2 * math.pi * bw * bw * F.count("*")), 6).alias("pdf"))


def orientation_density(s: SparkSession, d: str) -> DataFrame:
    """Density of every specimen's axes on the grid of 0.5 degrees (361 x 181): the axes of a specimen
    meet in one row, and its grid is one product of two matrices, rounded to six digits."""
    theta, phi = R.axis_angles(*[F.col(f"u{c}") for c in "xyz"])
    tasks = X.tasks_of(X.table(s, d, "part"))  # few bytes become many rows, as in the volumes
    held = _axes(s, d).select("specimen", F.struct("id", theta.alias("t"), phi.alias("p")).alias("a")).repartition(tasks, "specimen").groupBy("specimen").agg(F.sort_array(F.collect_list("a")).alias("axes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v in b.to_pylist():
                pdf = shape.density(np.array([(a["t"], a["p"]) for a in v["axes"]]))
                pdf = np.floor(pdf * 1e6 + 0.5) / 1e6  # here, as it costs more than the density where it is a column
                i, j = np.indices(pdf.shape, np.int32)
                yield pa.RecordBatch.from_pydict({"specimen": np.full(pdf.size, v["specimen"], np.int32), "i": i.ravel(), "j": j.ravel(), "pdf": pdf.ravel()})

    return held.mapInArrow(run, "specimen int, i int, j int, pdf double")


def da_convergence(s: SparkSession, d: str) -> DataFrame:
    """The reference's direction and line counts crossed, over all specimens, summarised over repetitions."""
    every = M.anisotropy_sweep(X.volumes(s, d))
    return parity.run_summary(every.withColumn("ok", F.col("status") == "OK"), ["specimen", "directions", "lines"], "da")


_LENGTHS = {"mean_length": 6, "max_length": 6, "mean_tortuosity": 9}
_AXIAL = {"axial_tortuosity": 9, "path_fraction": 9, "conductance": 6, "dissipation_gini": 6, "energy_error": 6}


def graph_summary(s: SparkSession, d: str) -> DataFrame:
    """Branch statistics by aggregation of the edge rows."""
    e = M.run(X.wires(s, d), M.graph_edges, "edge int, u int, v int, length double, pure_cycle boolean, distance double", "omit")
    bent = F.avg(F.when(F.col("distance") > 0, F.col("length") / F.col("distance")))
    return _round(e.groupBy("specimen").agg(F.count("*").alias("branches"), F.avg("length").alias("mean_length"), F.max("length").alias("max_length"), bent.alias("mean_tortuosity")), **_LENGTHS)


def skeleton_block(s: SparkSession, d: str) -> DataFrame:
    out = report.skeleton_block(M.run(X.wires(s, d), M.graph, M.GRAPH, "omit"), F.lit(X.N**3 * X.H_UM**3))
    return _round(out, **{c: 9 if c == "mean_tortuosity" else 6 for c in out.columns[1:]})


def terminals(s: SparkSession, d: str) -> DataFrame:
    n = M.run(X.wires(s, d), M.graph_nodes, "node int, x int, y int, z int, voxels int, top boolean, bottom boolean", "omit")
    return n.groupBy("specimen").agg(F.count_if("top").alias("top"), F.count_if("bottom").alias("bottom"), F.count_if(F.col("top") & F.col("bottom")).alias("both"))


_COUNTS = "d2 long, n long"
_TH = {"mean": 3, "sd": 3, "max": 3}
_Q = dict.fromkeys(("p10", "p25", "median", "p75", "p90"), 3)

_DIST = {"mean": 3, "sd": 3, "max": 3, **_Q, "iqr": 2, "cv": 5}
_SURFACE = {"area": 2, "vertex_area": 2, "volume": 0}
_DIGITS = {"conn_density": 15, "b0_density": 15, "b1_density": 15, "b2_density": 15, "bv_tv": 9, "bs_bv": 9, "bs_tv": 9, "delta_chi": 6, "connectivity": 6, "breadth": 6, "th_cv": 5, "sp_cv": 5}


#: Layers of a slab in the queries: not a divisor of a specimen's 24, and several slabs each.
_LAYERS = 7


def _slabs(s: SparkSession, d: str) -> DataFrame:
    return SL.from_volumes(X.volumes(s, d), _LAYERS)


def betti_slabs(s: SparkSession, d: str) -> DataFrame:
    return SL.topology(_slabs(s, d)).select("specimen", "b0", "b1", "b2")


def spanning_slabs(s: SparkSession, d: str) -> DataFrame:
    return SL.topology(_slabs(s, d)).select("specimen", "spans")


def edt_slabs(s: SparkSession, d: str) -> DataFrame:
    return SL.value_counts(SL.squared_distance(_slabs(s, d), _LAYERS, 2000), "d2")


def ridge_ball_slabs(s: SparkSession, d: str) -> DataFrame:
    return SL.value_counts(SL.ridge_balls(_slabs(s, d), _LAYERS, 2000), "r2")


def tb_th_slabs(s: SparkSession, d: str) -> DataFrame:
    return _round(SL.thickness(_slabs(s, d), _LAYERS, 2000).select("specimen", "mean", "sd", "max"), **_TH)


def radii_check(s: SparkSession, d: str) -> DataFrame:
    """Whether radii and eigenvalues of each fit tell the same anisotropy as the fit."""
    rows = parity.radii_check(quadric_fit(s, d).filter("status = 'OK'"))
    return rows.select("specimen", "rep", (F.col("difference") < 1e-9).alias("agree"))


def schema(mode: str) -> Query:
    """Result rows of a mode, doubles rounded to what sums in another order still share."""

    def query(s: SparkSession, d: str) -> DataFrame:
        rows = report.analyse(X.volumes(s, d), mode)
        return _round(rows, **{f.name: _DIGITS.get(f.name, 3) for f in rows.schema if f.dataType.simpleString() == "double" and f.name not in ("bv", "tv", "bs")})

    return query


def skeleton_topology(s: SparkSession, d: str) -> DataFrame:
    """Tunnels and voids of the skeletons of all ball specimens, which are those of the bone. (A small
    piece may vanish as a whole, so the number of pieces is no invariant.)"""
    return M.run(X.volumes(s, d), M.skeleton, M.SKELETON, "omit").select("specimen", "b1", "b2")


def header_names(s: SparkSession, d: str) -> DataFrame:
    """Headers of another tool's table under common names."""
    heads = ("BV (mm)", "TV", "BV/TV", "Tb.Th Mean (mm)", "Conn.D (mm)", "Corr. Euler", "Euler char.", "other")
    names = F.array(*[F.lit(f" {h} ") for h in heads])
    return X.table(s, d, "supplier").select("s_suppkey", parity.header_name(names[(F.col("s_suppkey") % len(heads)).cast("int")]).alias("name"))


QUERIES: dict[str, Query] = {
    "bv_tv": bv_tv,
    "phase_inside": phase_inside,
    "neighbours6": neighbours6,
    "degree26": degree26,
    "roi_boundary_fraction": _topology("boundary_fraction", boundary_fraction=9),
    "interface_faces": lambda s, d: _topology("interface_faces", "bs")(s, d).withColumnRenamed("interface_faces", "faces"),
    "euler_chi": _topology("euler"),
    "mean_breadth": _topology("breadth", breadth=6),
    "edge_correction": _topology("edge_correction", "delta_chi", "connectivity", edge_correction=6, delta_chi=6, connectivity=6),
    "conn_density": lambda s, d: _topology("connectivity")(s, d).select("specimen", F.round(F.col("connectivity") / float(X.REGION_VOXELS), 9).alias("conn_per_voxel")),
    "quadric_fit_few": quadric_fit_few,
    "degree_of_anisotropy_few": degree_of_anisotropy_few,
    "mil_points_few": _kernel(M.mil_points(**_FEW), "rep int, direction int, mx double, my double, mz double", "rep", "direction", "mx", "my", "mz", on_error="omit", mx=6, my=6, mz=6),
    "ef_stats_wires": _wires(M.ef(), M.EF, **dict.fromkeys(("mean", "sd", "median", "plate", "rod", "intermediate"), 5)),
    "plate_rod_wires": _wires(M.plate_rod(), M.PLATE_ROD, **dict.fromkeys(("plate", "rod", "intermediate", "mean_abs_ef", "plate_axial", "rod_axial"), 5)),
    "surface_cases_slabs": lambda s, d: SL.surface_cases(_slabs(s, d)),
    "mesh_surface_area_slabs": lambda s, d: _round(SL.surface(_slabs(s, d)).select("specimen", "area"), area=3),
    "betti_slabs": betti_slabs,
    "spanning_slabs": spanning_slabs,
    "edt_slabs": edt_slabs,
    "ridge_ball_slabs": ridge_ball_slabs,
    "tb_th_slabs": tb_th_slabs,
    "betti": _kernel(M.betti, M.BETTI, "b0", "b1", "b2", on_error="omit"),
    **{f"beta{b[1]}": _kernel(M.betti, M.BETTI, b, on_error="omit") for b in ("b0", "b1", "b2")},
    "spanning": _kernel(M.betti, M.BETTI, "spans", on_error="omit"),
    "betti_density": _kernel(M.betti, M.BETTI, "b0_density", "b1_density", "b2_density", "spans", on_error="omit"),
    "edt_squared": _kernel(M.thickness_counts("distance"), _COUNTS, on_error="omit"),
    "ridge_templates": ridge_templates,
    "distance_ridge": _kernel(M.thickness_counts("ridge"), _COUNTS, on_error="omit"),
    "ridge_ball": _kernel(M.thickness_counts("balls"), _COUNTS, on_error="omit"),
    "tb_th": _kernel(M.thickness(True), M.DISTRIBUTION, *_TH, on_error="omit", **_TH),
    "tb_sp": _kernel(M.thickness(False), M.DISTRIBUTION, *_TH, on_error="omit", **_TH),
    "thickness_quantiles": _kernel(M.thickness(True), M.DISTRIBUTION, *_Q, on_error="omit", **_Q),
    "thickness_clean": _kernel(M.thickness(True), M.DISTRIBUTION, **_DIST),
    "thickness_stats": _kernel(M.thickness(False), M.DISTRIBUTION, **_DIST),
    "thickness_raw": _kernel(M.thickness(True, clean=False), M.DISTRIBUTION, **_DIST),
    "mesh_surface_area": _kernel(M.surface, M.SURFACE, "area", on_error="omit", area=3),
    "midpoint_mesh": lambda s, d: _kernel(M.surface, M.SURFACE, "midpoint_area", on_error="omit", midpoint_area=3)(s, d).withColumnRenamed("midpoint_area", "area"),
    "surface_cases": _kernel(M.surface_cases, "case int, n long", on_error="omit"),
    "vertex_area": _kernel(M.isosurface(30.0), M.ISOSURFACE, "area", "vertex_area", on_error="omit", area=2, vertex_area=2),
    "isosurface": _kernel(M.isosurface(30.0), M.ISOSURFACE, on_error="omit", **_SURFACE),
    "sdf": _kernel(M.field("distance"), M.FIELD, "n", "high", "low", "total", "squares", on_error="omit", high=6, low=6, total=3),
    "gaussian_smooth": _kernel(M.field("smooth"), M.FIELD, "n", "high", "low", "total", on_error="omit", high=4, low=4, total=2),
    "curvature_grid": _kernel(M.field("curvature"), M.FIELD, on_error="omit", low=6, high=6, total=4, squares=4),
    "curvature_stats": wide(M.curvature(), M.CURVATURE),
    "curvature_summary": curvature_summary,
    "w102": wide(M.w102(), M.W102),
    "euler_lut": euler_lut,
    "skeleton": _wires(M.skeleton, M.SKELETON),
    "skeleton_topology": skeleton_topology,
    "skeleton_balls": _kernel(M.skeleton, M.SKELETON),
    "junction_clusters": _wires(M.graph, M.GRAPH, "junction_voxels", "junction_clusters", on_error="omit"),
    "skeleton_degree": lambda s, d: M.run(X.wires(s, d), M.skeleton_points, "x int, y int, z int, degree int", "omit").groupBy("specimen", "degree").agg(F.count("*").alias("voxels")),
    "graph_stats": _wires(M.graph, M.GRAPH, **_LENGTHS),
    "graph_stats_balls": _kernel(M.graph, M.GRAPH),
    "graph_edges": _wires(M.graph_edges, "edge int, u int, v int, length double, pure_cycle boolean, distance double", length=6, distance=6),
    "compressed_graph": _wires(M.graph_nodes, "node int, x int, y int, z int, voxels int, top boolean, bottom boolean"),
    "graph_summary": graph_summary,
    "skeleton_block": skeleton_block,
    "terminals": terminals,
    "collapsed_edges": collapsed_edges,
    "axial_graph": _wires(M.axial, M.AXIAL, **_AXIAL),
    "axial_graph_foam": lambda s, d: M.run(X.foam(s, d), M.axial, M.AXIAL),
    "axial_shortest_path": _wires(M.axial, M.AXIAL, "axial_tortuosity", axial_tortuosity=9),
    "edge_connectivity": _wires(M.axial, M.AXIAL, "edge_connectivity", "n_top", "n_bottom"),
    "cz_fraction": _wires(M.axial, M.AXIAL, "path_fraction", path_fraction=9),
    "dissipation_gini": _wires(M.axial, M.AXIAL, "dissipation_gini", "conductance", "energy_error", **{k: _AXIAL[k] for k in ("dissipation_gini", "conductance", "energy_error")}),
    "gini": gini,
    "weighted_quantile": weighted_quantile,
    "rep_summary": rep_summary,
    "convergence_summary": convergence_summary,
    "window_points": window_points,
    "window_moments": window_moments,
    "ef_stats": _kernel(M.ef(), M.EF),
    "plate_rod": _kernel(M.plate_rod(), M.PLATE_ROD),
    "grid_representatives": grid_representatives,
    "orientation_samples": _kernel(M.orientation_samples, "x int, y int, z int, kind string, vx double, vy double, vz double, ef double, thickness_vox double, radius_vox int"),
    "soi": lambda s, d: M.run(X.foam(s, d), M.soi, M.SOI),
    "t50": _wires(M.soi, M.SOI, "t50", "n_grid_representatives"),
    "orientation_kde": orientation_kde,
    "orientation_density": orientation_density,
    "canonical_axis": canonical_axis,
    "axis_angles": axis_angles,
    "axis_angle": axis_angle,
    "misorientation": misorientation,
    "orthogonality": orthogonality,
    "da_domain": da_domain,
    "splitmix64": splitmix64,
    "ray_box": ray_box,
    "mil_points": _kernel(M.mil_points(), "rep int, direction int, mx double, my double, mz double"),
    "quadric_fit": quadric_fit,
    "eigh3": eigh3,
    "degree_of_anisotropy": degree_of_anisotropy,
    "da_convergence": da_convergence,
    "unit_scale": unit_scale,
    "spacing_isotropy": spacing_isotropy,
    "spacing_table": spacing_table,
    "spacing_join": spacing_join,
    "roi_match": roi_match,
    "specimen_code": specimen_code,
    "input_qc": input_qc,
    "tiff_roundtrip": tiff_roundtrip,
    "parity_report": parity_report,
    "parity_differences": parity_differences,
    "radii_check": radii_check,
    "header_names": header_names,
    **{f"schema_{mode}": schema(mode) for mode in ("bonej", "classic", "refined", "experimental")},
    "schema_standard": lambda s, d: report.analyse(X.volumes(s, d), "standard", Config(roi_dir="-")),
    "families_core": lambda s, d: report.analyse(X.volumes(s, d), "standard", Config(roi_dir="-", preset="core")),
    "descriptor_catalog": lambda s, d: report.catalogue(s),
}
