"""Result rows: schemas of the modes and descriptor families, joins of measures, sinks."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import fields, intercepts, networks, shape, thinning, voxels
from voxloom.functions.voxels import MorphometryError
from voxloom.operators import measures as M
from voxloom.operators.specimens import per_specimen
from voxloom.session import Config

# Output columns of each mode, in order, as (our name, their name).
BONEJ = (
    ("bv", "BV"), ("tv", "TV"), ("bv_tv", "BV/TV"), ("euler", "Euler characteristic"), ("delta_chi", "Euler change/correction"),
    ("connectivity", "Connectivity"), ("conn_density", "Connectivity density"), ("th_mean", "Tb.Th Mean"), ("th_sd", "Tb.Th Std Dev"), ("th_max", "Tb.Th Max"),
    ("sp_mean", "Tb.Sp Mean"), ("sp_sd", "Tb.Sp Std Dev"), ("sp_max", "Tb.Sp Max"),
)
CLASSIC = (
    ("th_mean", "Tb.Th Mean (µm)"), ("th_sd", "Tb.Th Std Dev (µm)"), ("th_max", "Tb.Th Max (µm)"), ("sp_mean", "Tb.Sp Mean (µm)"), ("sp_sd", "Tb.Sp Std Dev (µm)"), ("sp_max", "Tb.Sp Max (µm)"),
    ("bv", "BV (micron^3)"), ("tv", "TV (micron^3)"), ("bv_tv", "BV/TV"), ("euler", "Euler χ (ROI-clipped)"), ("b1", "Connectivity β1 (ROI-clipped)"), ("b1_density", "Connectivity Density (µm⁻³)"),
)
REFINED = (*CLASSIC, ("bs", "BS (µm²)"), ("breadth", "Mean Breadth (µm; ROI-clipped)"))
EXPERIMENTAL = (
    ("bv", "BV"), ("tv", "TV"), ("bv_tv", "BV/TV"), ("th_median", "Tb.Th Median"), ("th_p10", "Tb.Th P10"), ("th_p90", "Tb.Th P90"), ("th_cv", "Tb.Th CV"),
    ("sp_median", "Tb.Sp Median"), ("sp_p10", "Tb.Sp P10"), ("sp_p90", "Tb.Sp P90"), ("sp_cv", "Tb.Sp CV"), ("b0_density", "Beta0 density"), ("b1_density", "Beta1 density"), ("b2_density", "Beta2 density"),
    ("bs", "BS"), ("bs_bv", "BS/BV"), ("bs_tv", "BS/TV"), ("breadth", "Mean Breadth"),
)
_MAP = ("P10", "P25", "Median", "P75", "P90", "IQR")
STANDARD = (
    ("bv", "BV (µm³)"), ("tv", "TV (µm³)"), ("bv_tv", "BV/TV"), ("euler", "Euler characteristic"), ("delta_chi", "Euler change/correction"), ("edge_correction", "BoneJ edge correction"),
    ("connectivity", "Connectivity"), ("conn_density", "Connectivity density (µm⁻³)"),
    *((f"{p}_{k}", f"Tb.{n} {t}") for p, n in (("th", "Th"), ("sp", "Sp")) for k, t in (("mean", "Mean (µm)"), ("sd", "Std Dev (µm)"), ("max", "Max (µm)"), *((q.lower(), f"{q} (µm; map-derived)") for q in _MAP), ("cv", "CV (map-derived)"))),
    ("area", "BS mesh (µm²; BoneJ-comparable candidate)"), ("area_bv", "BS/BV mesh (µm⁻¹; BoneJ-comparable candidate)"), ("area_tv", "BS/TV mesh (µm⁻¹; BoneJ-comparable candidate)"),
    ("da_mean", "DA mean (native MIL candidate)"), ("da_sd", "DA SD (native MIL candidate)"), ("da_cv", "DA CV (native MIL candidate)"), ("da_min", "DA min across repetitions (native MIL candidate)"), ("da_max", "DA max across repetitions (native MIL candidate)"),
    ("angle_mean", "DA principal angle to Z mean (deg)"), ("radius_a", "DA radius a mean (vox; shortest)"), ("radius_b", "DA radius b mean (vox)"), ("radius_c", "DA radius c mean (vox; longest)"), ("side", "DA domain side (vox)"), ("depth", "DA domain depth (vox)"),
    ("ef_mean", "EF mean (native candidate)"), ("ef_sd", "EF SD (native candidate)"), ("ef_median", "EF median (native candidate)"), ("ef_plate", "EF plate fraction (<-0.25; native candidate)"), ("ef_rod", "EF rod fraction (>0.25; native candidate)"), ("ef_intermediate", "EF intermediate fraction (native candidate)"), ("ef_n", "EF sampled skeleton seeds"),
    ("bs", "Cubical BS legacy (µm²)"), ("breadth", "Mean Breadth legacy (µm; ROI-clipped)"),
)
ADVANCED = (
    ("cu_sigma", "Curvature SDF sigma (µm)"), ("cu_margin", "Curvature image-support margin (µm)"), ("cu_area_used", "Curvature selected surface area (µm²)"), ("cu_h_mean", "Curvature H area-weighted mean (µm⁻¹)"), ("cu_h_sd", "Curvature H area-weighted SD (µm⁻¹)"), ("cu_h_abs_mean", "Curvature |H| area-weighted mean (µm⁻¹)"),
    ("cu_k_median", "Curvature K area-weighted median (µm⁻²)"), ("cu_k_iqr", "Curvature K area-weighted IQR (µm⁻²)"), ("cu_k_abs_p90", "Curvature |K| area-weighted P90 (µm⁻²)"), ("cu_k_abs_p99", "Curvature |K| area-weighted P99 (µm⁻²)"),
    ("cu_saddle", "Curvature saddle area fraction"), ("cu_convex", "Curvature convex area fraction"), ("cu_concave", "Curvature concave area fraction"), ("cu_negative_discriminant", "Curvature H²-K<0 area fraction (QC)"),
    ("cu_n_used", "Curvature selected vertices"), ("cu_n_outside", "Curvature ROI-excluded vertices"), ("cu_n_margin", "Curvature image-support-excluded vertices"), ("cu_n_invalid", "Curvature invalid vertices"),
    ("gr_skeleton_voxels", "Skeleton voxels"), ("gr_endpoint_voxels", "Skeleton endpoint voxels"), ("gr_slab_voxels", "Skeleton slab voxels"), ("gr_junction_voxels", "Skeleton junction voxels"), ("gr_junction_clusters", "Skeleton junction clusters"),
    ("gr_branches", "Graph branches"), ("gr_components", "Graph components"), ("gr_cycle_rank", "Graph cycle rank"), ("gr_mean_length", "Graph mean branch length (µm)"), ("gr_max_length", "Graph max branch length (µm)"), ("gr_mean_tortuosity", "Graph mean branch tortuosity"), ("gr_spanning", "Graph top-bottom spanning"),
    ("pr_plate", "PR proxy plate-seed fraction"), ("pr_rod", "PR proxy rod-seed fraction"), ("pr_intermediate", "PR proxy intermediate-seed fraction"), ("pr_rod_axial", "PR proxy rod axial fraction"), ("pr_plate_axial", "PR proxy plate-normal axial fraction"), ("pr_mean_abs_ef", "PR proxy mean |EF|"), ("pr_n", "PR proxy classified seeds"),
)
FAMILY_COLUMNS = {
    "paper": (("bv_tv", "paper_morphometry.BVTV"), ("th_mean", "paper_morphometry.TbTh_mean_um"), ("sp_mean", "paper_morphometry.TbSp_mean_um"), ("conn_density", "paper_morphometry.ConnD_um_inv3"), ("da_mean", "paper_morphometry.DA_mean")),
    "skeleton": (
        ("length_density", "skeleton.length_density_mm_per_mm3"), ("branch_density", "skeleton.branch_density_per_mm3"), ("junction_density", "skeleton.junction_cluster_density_per_mm3"), ("endpoint_density", "skeleton.endpoint_density_per_mm3"),
        ("cycle_density", "skeleton.cycle_density_per_mm3"), ("component_density", "skeleton.graph_component_density_per_mm3"), ("gr_mean_length", "skeleton.mean_branch_length_um"), ("gr_mean_tortuosity", "skeleton.mean_branch_tortuosity"),
    ),
    "mechanical": (("axial_tortuosity", "mechanical_graph.axial_shortest_path_tortuosity"), ("edge_connectivity", "mechanical_graph.axial_edge_connectivity"), ("path_fraction", "mechanical_graph.Cz_path_length_fraction"), ("conductance", "mechanical_graph.axial_normalized_conductance"), ("dissipation_gini", "mechanical_graph.axial_dissipation_gini")),
    "soi": (("soi", "soi_proxy.SOI_proxy"), ("p_o", "soi_proxy.pO"), ("r_o", "soi_proxy.rO"), ("pr_o", "soi_proxy.prO"), ("n_plate", "soi_proxy.n_plate"), ("n_rod", "soi_proxy.n_rod"), ("n_classified", "soi_proxy.n_classified"), ("n_grid_representatives", "soi_proxy.n_grid_representatives"), ("t50", "soi_proxy.t50_um")),
    "orientation": (("plate_misorientation", "orientation_field.plate_local_misorientation_deg"), ("rod_misorientation", "orientation_field.rod_local_misorientation_deg"), ("orthogonality_deviation", "orientation_field.plate_rod_local_orthogonality_deviation_deg")),
    "minkowski": (("w102_da", "minkowski_w102.W102_DA"), ("w102_mid_over_max", "minkowski_w102.W102_mid_over_max"), ("w102_triangles", "minkowski_w102.selected_triangles"), ("w102_area", "minkowski_w102.selected_surface_area_um2")),
}
MODES = {"bonej": BONEJ, "classic": CLASSIC, "refined": REFINED, "experimental": EXPERIMENTAL, "standard": STANDARD}
CATALOGUE = (
    ("paper", "bone volume fraction, thickness, separation, connectivity density, anisotropy"),
    ("skeleton", "eight normalised skeleton descriptors"),
    ("mechanical", "five axial path and transport descriptors of the skeleton graph"),
    ("soi", "structural organisation of plates and rods with its quality counts"),
    ("orientation", "three local orientation descriptors"),
    ("minkowski", "anisotropy of the surface-normal tensor"),
)


def columns(mode: str = "standard", advanced: bool = False, families: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(our name, output name) of a run's columns after the file name."""
    if families:
        return [c for f in families for c in FAMILY_COLUMNS[f]]
    return [*MODES[mode], *(ADVANCED if advanced else ())]


class _Measured:
    """What a specimen's columns are computed from; each part is made once, when asked for."""

    def __init__(self, bone: np.ndarray, roi: np.ndarray, h: float, cfg: Config):
        self.bone, self.roi, self.h, self.cfg = bone, roi, h, cfg
        self.inside = voxels.phase(bone, roi, True)
        if not roi.any() or not self.inside.any() or not (roi & ~bone).any():
            raise MorphometryError("the region needs both phases")
        if cfg.mode == "bonej" and roi.all():
            raise MorphometryError("the region must not be the whole image")

    def skeleton(self) -> np.ndarray:
        if not hasattr(self, "_skeleton"):
            self._skeleton = thinning.skeletonize(self.inside)
        return self._skeleton

    def network(self) -> networks.Network:
        if not hasattr(self, "_network"):
            self._network = networks.Network.of(self.skeleton(), self.h)
        return self._network

    def shapes(self) -> list[dict]:
        if not hasattr(self, "_shapes"):
            self._shapes = shape.cube_shapes(self.inside, self.skeleton(), self.cfg.ef_window_radius)
        return self._shapes

    def part(self, name: str) -> dict:
        b, r, h, c = self.bone, self.roi, self.h, self.cfg
        pre = lambda p, d: {f"{p}_{k}": v for k, v in d.items()}
        if name == "topology":
            return M.topology(b, r, h)
        if name == "betti":
            return M.betti(b, r, h)
        if name in ("th", "sp"):
            return pre(name, M.thickness(name == "th")(b, r, h))
        if name == "surface":
            return M.surface(b, r, h)
        if name == "da":
            square = intercepts.domain(r)
            reps = [intercepts.anisotropy(intercepts.cloud(self.inside, square, c.da_seed, i, c.da_directions, c.da_lines, c.da_increment)) for i in range(c.da_repetitions)]
            return intercepts.over_repetitions(reps) | {"side": square[2], "depth": b.shape[0]}
        if name == "ef":
            return pre("ef", shape.ef_stats(self.shapes()))
        if name == "pr":
            return pre("pr", shape.plate_rod(self.shapes()))
        if name == "cu":
            return pre("cu", {"sigma": c.curvature_sigma_um, "margin": fields.SUPPORT_SIGMAS * c.curvature_sigma_um} | fields.curvature_stats(b, r, h, c.curvature_sigma_um))
        if name == "gr":
            return pre("gr", self.network().stats())
        if name == "density":
            g, tv = self.network().stats(), float(r.sum()) * h**3 * 1e-9
            length = g["mean_length"] * g["branches"] / 1000 if g["branches"] else 0.0
            return {"length_density": length / tv, "branch_density": g["branches"] / tv, "junction_density": g["junction_clusters"] / tv, "endpoint_density": g["endpoint_voxels"] / tv, "cycle_density": g["cycle_rank"] / tv, "component_density": g["components"] / tv}
        if name == "axial":
            return networks.axial_stats(self.network())
        if name == "soi":
            found, t50 = shape.orientation_samples(self.inside, self.skeleton(), h)
            n = len(shape.grid_representatives(np.argwhere(self.skeleton())[:, ::-1], t50, h))
            return shape.soi(found) | shape.orientation_field(found, h, t50) | {"t50": t50, "n_classified": len(found), "n_grid_representatives": n}
        w = fields.w102(b, r, h)
        return {"w102_da": w["w102_da"], "w102_mid_over_max": w["w102_mid_over_max"], "w102_triangles": w["triangles"], "w102_area": w["area"]}


_PARTS = {
    "topology": {"bv", "tv", "bv_tv", "euler", "delta_chi", "edge_correction", "connectivity", "conn_density", "bs", "bs_bv", "bs_tv", "breadth"},
    "betti": {"b0", "b1", "b2", "b0_density", "b1_density", "b2_density"},
    "surface": {"area", "area_bv", "area_tv"},
    "da": {"da_mean", "da_sd", "da_cv", "da_min", "da_max", "angle_mean", "radius_a", "radius_b", "radius_c", "side", "depth"},
    "density": {"length_density", "branch_density", "junction_density", "endpoint_density", "cycle_density", "component_density"},
    "axial": {"axial_tortuosity", "edge_connectivity", "path_fraction", "conductance", "dissipation_gini"},
    "soi": {"soi", "p_o", "r_o", "pr_o", "n_plate", "n_rod", "n_classified", "n_grid_representatives", "t50", "plate_misorientation", "rod_misorientation", "orthogonality_deviation"},
}


def _part_of(column: str) -> str:
    return next((p for p, names in _PARTS.items() if column in names), column.split("_")[0])


_WHOLE = {"euler", "side", "depth", "ef_n", "pr_n", "n_plate", "n_rod", "n_classified", "n_grid_representatives", "edge_connectivity", "w102_triangles", "b1"}


def analyse(volumes: DataFrame, mode: str = "standard", config: Config | None = None, on_error: str = "omit") -> DataFrame:
    """One row for each specimen with the columns of a mode or of descriptor families. Only what
    the columns need is computed."""
    cfg = config or Config(mode=mode, roi_dir="-")
    wanted = [c for c, _ in columns(cfg.mode, cfg.advanced, cfg.families)]
    parts = list(dict.fromkeys(_part_of(c) for c in wanted))
    kind = lambda c: "boolean" if c == "gr_spanning" else "long" if c in _WHOLE or (c.startswith(("cu_n_", "gr_")) and not c.startswith(("gr_m", "cu_ne"))) else "double"

    def kernel(bone, roi, h) -> dict:
        m = _Measured(bone, roi, h, cfg)
        out: dict = {}
        for p in parts:
            out |= m.part(p)
        return {c: int(out[c]) if kind(c) == "long" else out[c] for c in wanted}

    return per_specimen(volumes, kernel, ", ".join(f"{c} {kind(c)}" for c in wanted), on_error)


def named(rows: DataFrame, filename: str = "specimen", **which) -> DataFrame:
    """Rows under their output names, the file name first."""
    return rows.select(F.col(filename).cast("string").alias("filename"), *[F.col(a).alias(b) for a, b in columns(**which)])


def plain_decimal(value: Column) -> Column:
    """A double as the shortest decimal that reads back as the same value, never with an exponent, whole
    numbers without a point. In Arrow batches: rows of the sink are few."""

    @F.pandas_udf("string")
    def written(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or x is pd.NA else "NaN" if x != x else np.format_float_positional(x, trim="-") if np.isfinite(x) else "inf" if x > 0 else "-inf" for x in v.tolist()], dtype=object)

    return F.when(value.isNotNull(), written(value.cast("double")))


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file of that name with a header; an existing one is replaced.

    ``rows`` are expected as a written table (``session.cut``): only their small result is merged
    here by one task, the kernels have run in parallel before. Doubles are plain decimals.
    """
    spark = rows.sparkSession
    shown = rows.select(*[plain_decimal(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f"`{f.name}`") for f in rows.schema])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.part-{uuid.uuid4().hex}")
    shown.coalesce(1).write.csv(beside.toString(), header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    made = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{beside.toString()}/part-*.csv"))
    fs.delete(target, True)
    if not fs.rename(made[0].getPath(), target):
        raise OSError(f"cannot write {path}")
    fs.delete(beside, True)


def skeleton_block(graph: DataFrame, tv_um3: Column) -> DataFrame:
    """Densities by cubic millimetre from graph statistics and the region's volume."""
    tv = tv_um3 * 1e-9
    per = {"branch_density": "branches", "junction_density": "junction_clusters", "endpoint_density": "endpoint_voxels", "cycle_density": "cycle_rank", "component_density": "components"}
    return graph.select("specimen", (F.col("mean_length") * F.col("branches") / 1000 / tv).alias("length_density"), *[(F.col(c) / tv).alias(n) for n, c in per.items()], "mean_length", "mean_tortuosity")


def match_regions(files: DataFrame, regions: DataFrame, root: str, region_root: str) -> DataFrame:
    """Files with the region file of the same relative path; roi_path is null without one."""
    rel = lambda r: F.expr(f"substring(path, {len(r) + 1})")
    a = files.select("path", rel(root).alias("relative"))
    b = regions.select(F.col("path").alias("roi_path"), rel(region_root).alias("relative"))
    return a.join(b, "relative", "left")


def input_qc(counts: DataFrame) -> DataFrame:
    """foreground, background, h_um to checks: both phases, spacing outside 20 to 25 micrometres."""
    warn = F.when(F.col("h_um").isNull(), "no calibration").when((F.col("h_um") < 20) | (F.col("h_um") > 25), "spacing outside the calibrated range")
    return counts.select("specimen", "foreground", "background", ((F.col("foreground") > 0) & (F.col("background") > 0)).alias("both_phases"), warn.alias("warning"))


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "family string, descriptors string")
