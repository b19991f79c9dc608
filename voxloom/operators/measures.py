"""Measures of specimens: each is a kernel over volumes, with its columns."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxloom.functions import fields, intercepts, networks, shape, surfaces, thinning, voxels
from voxloom.functions.voxels import MorphometryError
from voxloom.operators.specimens import per_specimen, unpack


def _d(names: str, kind: str = "double") -> str:
    return ", ".join(f"{n} {kind}" for n in names.split())


TOPOLOGY = _d("bone_voxels tv_voxels interface_faces vertices edges faces cubes euler", "long") + ", " + _d("bv tv bv_tv boundary_fraction breadth edge_correction delta_chi connectivity conn_density bs bs_bv bs_tv")


def topology(bone, roi, h) -> dict:
    """Volumes, cubical surface and topology of the clipped bone."""
    inside = voxels.phase(bone, roi, True)
    n, tv = int(inside.sum()), int(roi.sum())
    if not tv:
        raise MorphometryError("empty region")
    m = voxels.cubical_measures(inside)
    faces = voxels.interface_faces(bone, roi)
    bs = faces * h * h
    out = {"bone_voxels": n, "tv_voxels": tv, "interface_faces": faces, "bv": n * h**3, "tv": tv * h**3, "bv_tv": n / tv, "boundary_fraction": voxels.boundary_bone_fraction(bone, roi), "bs": bs, "bs_bv": bs / (n * h**3) if n else float("nan"), "bs_tv": bs / (tv * h**3)}
    return out | m | {"breadth": m["breadth"] * h, "conn_density": m["connectivity"] / (tv * h**3)}


BETTI = _d("b0 b1 b2", "long") + ", " + _d("b0_density b1_density b2_density") + ", spans boolean"


def betti(bone, roi, h) -> dict:
    inside = voxels.phase(bone, roi, True)
    b = voxels.betti(inside)
    tv = int(roi.sum()) * h**3
    return dict(zip(("b0", "b1", "b2"), b, strict=True)) | {f"b{i}_density": x / tv for i, x in enumerate(b)} | {"spans": voxels.spans(inside)}


DISTRIBUTION = _d("mean sd max p10 p25 median p75 p90 iqr cv")


def thickness(want: bool, clean: bool = True):
    """Statistics of local thickness of bone (want) or marrow inside the region."""

    def kernel(bone, roi, h) -> dict:
        return voxels.distribution(voxels.local_thickness(voxels.phase(bone, roi, want), clean), h)

    return kernel


def thickness_counts(stage: str):
    """Voxel counts by squared value: of the distance, of its ridge, of the propagated balls."""

    def kernel(bone, roi, h) -> list[dict]:
        inside = voxels.phase(bone, roi, True)
        d2 = voxels.squared_distance(inside)
        v = d2 if stage == "distance" else np.where(voxels.distance_ridge(d2), d2, 0)
        if stage == "balls":
            v = voxels.propagate(d2, v > 0)
        values, counts = np.unique(v[v > 0], return_counts=True)
        return [{"d2": a, "n": b} for a, b in zip(values.tolist(), counts.tolist(), strict=True)]

    return kernel


SURFACE = _d("area midpoint_area area_bv area_tv")


def surface(bone, roi, h) -> dict:
    inside = voxels.phase(bone, roi, True)
    a = surfaces.binary_area(inside, h)
    return {"area": a, "midpoint_area": surfaces.binary_area(inside, h, "middle"), "area_bv": a / (inside.sum() * h**3), "area_tv": a / (roi.sum() * h**3)}


def surface_cases(bone, roi, h) -> list[dict]:
    counts = surfaces.case_histogram(voxels.phase(bone, roi, True))
    return [{"case": int(c), "n": int(counts[c])} for c in np.flatnonzero(counts) if 0 < c < 255]


ISOSURFACE = "vertices long, triangles long, area double, vertex_area double, volume double"


def isosurface(sigma_um: float):
    """Level set of the smoothed signed distance: counts, area, area by vertices, volume inside."""

    def kernel(bone, roi, h) -> dict:
        phi = fields.smooth(fields.signed_distance(bone, h), sigma_um / h)
        v, t = surfaces.isosurface(np.pad(phi, 1, constant_values=-h))
        n = surfaces.triangle_vectors(v * h, t)
        return {"vertices": len(v), "triangles": len(t), "area": float(np.linalg.norm(n, axis=1).sum() / 2), "vertex_area": float(surfaces.vertex_areas(v * h, t).sum()), "volume": abs(float((v[t[:, 0]] * h * n).sum() / 6))}

    return kernel


FIELD = "n long, low double, high double, total double, squares double"


def field(which: str, sigma_um: float = 30.0):
    def kernel(bone, roi, h) -> dict:
        phi = fields.signed_distance(bone, h)
        if which == "smooth":
            phi = fields.smooth(phi, sigma_um / h)
        if which == "curvature":
            phi = fields.curvature(fields.smooth(phi, sigma_um / h), h)[0]
            phi = phi[np.isfinite(phi)]
        return {"n": phi.size, "low": float(phi.min()), "high": float(phi.max()), "total": float(phi.sum()), "squares": float((phi * phi).sum())}

    return kernel


CURVATURE = _d("n_vertices n_used n_margin n_outside n_invalid", "long") + ", " + _d("area area_used h_mean h_sd h_abs_mean k_median k_iqr k_abs_p90 k_abs_p99 saddle convex concave negative_discriminant")


def curvature(sigma_um: float = 30.0, margin_sigmas: float = fields.SUPPORT_SIGMAS):
    return lambda bone, roi, h: fields.curvature_stats(bone, roi, h, sigma_um, margin_sigmas)


W102 = "triangles long, " + _d("area w102_da w102_mid_over_max")


def w102(margin_um: float = fields.W102_MARGIN_UM, least: int = fields.W102_LEAST_TRIANGLES):
    return lambda bone, roi, h: fields.w102(bone, roi, h, margin_um=margin_um, least=least)


def skeleton_of(bone, roi) -> np.ndarray:
    return thinning.skeletonize(voxels.phase(bone, roi, True))


SKELETON = _d("bone_voxels skeleton_voxels endpoint_voxels slab_voxels junction_voxels b0 b1 b2", "long")


def skeleton(bone, roi, h) -> dict:
    s = skeleton_of(bone, roi)
    d = voxels.neighbour_counts(s)[s]
    b = voxels.betti(s)
    return {"bone_voxels": int((bone & roi).sum()), "skeleton_voxels": int(s.sum()), "endpoint_voxels": int((d <= 1).sum()), "slab_voxels": int((d == 2).sum()), "junction_voxels": int((d > 2).sum())} | dict(zip(("b0", "b1", "b2"), b, strict=True))


def skeleton_points(bone, roi, h) -> list[dict]:
    s = skeleton_of(bone, roi)
    d = voxels.neighbour_counts(s)
    return [{"x": x, "y": y, "z": z, "degree": int(d[z, y, x])} for z, y, x in np.argwhere(s).tolist()]


GRAPH = _d("skeleton_voxels endpoint_voxels slab_voxels junction_voxels junction_clusters components branches cycle_rank", "long") + ", " + _d("mean_length max_length mean_tortuosity") + ", spanning boolean"


def graph(bone, roi, h) -> dict:
    return networks.Network.of(skeleton_of(bone, roi), h).stats()


def graph_edges(bone, roi, h) -> list[dict]:
    n = networks.Network.of(skeleton_of(bone, roi), h)
    return [{"edge": i, "u": e.u, "v": e.v, "length": e.length, "pure_cycle": e.pure_cycle, "distance": n.distance(n.nodes[e.u][0], n.nodes[e.v][0])} for i, e in enumerate(n.edges)]


def graph_nodes(bone, roi, h) -> list[dict]:
    n = networks.Network.of(skeleton_of(bone, roi), h)
    lo, hi = min(p[2] for p in n.points), max(p[2] for p in n.points)
    return [{"node": i, "x": ps[0][0], "y": ps[0][1], "z": ps[0][2], "voxels": len(ps), "top": any(p[2] <= lo + 1 for p in ps), "bottom": any(p[2] >= hi - 1 for p in ps)} for i, ps in enumerate(n.nodes)]


AXIAL = _d("axial_tortuosity path_fraction conductance dissipation_gini energy_error") + ", " + _d("edge_connectivity n_top n_bottom", "long")


def axial(bone, roi, h) -> dict:
    return networks.axial_stats(networks.Network.of(skeleton_of(bone, roi), h))


EF = "n long, " + _d("mean sd median plate rod intermediate")
PLATE_ROD = "n long, " + _d("plate rod intermediate mean_abs_ef plate_axial rod_axial")


def ef(radius: int = 4):
    def kernel(bone, roi, h) -> dict:
        inside = voxels.phase(bone, roi, True)
        return shape.ef_stats(shape.cube_shapes(inside, thinning.skeletonize(inside), radius))

    return kernel


def plate_rod(radius: int = 4):
    def kernel(bone, roi, h) -> dict:
        inside = voxels.phase(bone, roi, True)
        return shape.plate_rod(shape.cube_shapes(inside, thinning.skeletonize(inside), radius))

    return kernel


def orientation_samples(bone, roi, h) -> list[dict]:
    inside = voxels.phase(bone, roi, True)
    found, _ = shape.orientation_samples(inside, thinning.skeletonize(inside), h)
    return [s | {"vx": s["vector"][0], "vy": s["vector"][1], "vz": s["vector"][2]} for s in found]


SOI = _d("n_plate n_rod n_classified n_grid_representatives plate_centers rod_centers", "long") + ", " + _d("p_o r_o pr_o soi t50 plate_misorientation rod_misorientation orthogonality_deviation")


def soi(bone, roi, h) -> dict:
    inside = voxels.phase(bone, roi, True)
    s = thinning.skeletonize(inside)
    found, t50 = shape.orientation_samples(inside, s, h)
    n = len(shape.grid_representatives(np.argwhere(s)[:, ::-1], t50, h))
    return shape.soi(found) | shape.orientation_field(found, h, t50) | {"t50": t50, "n_classified": len(found), "n_grid_representatives": n}


DA = _d("da_mean da_sd da_cv da_min da_max angle_mean radius_a radius_b radius_c") + ", side int, depth int"


def mil_points(directions: int = intercepts.DIRECTIONS, lines: int = intercepts.LINES, repetitions: int = intercepts.REPETITIONS, increment: float = intercepts.INCREMENT, seed: int = intercepts.SEED):
    def kernel(bone, roi, h) -> list[dict]:
        inside, square = voxels.phase(bone, roi, True), intercepts.domain(roi)
        clouds = [intercepts.cloud(inside, square, seed, rep, directions, lines, increment) for rep in range(repetitions)]
        return [{"rep": rep, "direction": i, "mx": x, "my": y, "mz": z} for rep, p in enumerate(clouds) for i, (x, y, z) in enumerate(p.tolist())]

    return kernel


_QUADRIC = _d("da angle_deg radius_a radius_b radius_c d1 d2 d3") + ", side int, depth int"


def anisotropy_repetitions(volumes: DataFrame, directions: int = intercepts.DIRECTIONS, lines: int = intercepts.LINES, repetitions: int = intercepts.REPETITIONS, increment: float = intercepts.INCREMENT, seed: int = intercepts.SEED) -> DataFrame:
    """One quadric for each specimen and repetition. Repetitions have random streams of their own; they are
    made where the specimen is, so no volume is moved or copied."""
    return anisotropy_sweep(volumes, (directions,), (lines,), repetitions, increment, seed).drop("directions", "lines")


#: The reference's sweep.
SWEEP_DIRECTIONS, SWEEP_LINES, SWEEP_REPETITIONS = (64, 128, 256, 512, 1024, 2048), (8, 16, 32, 64, 128), 3


def anisotropy_sweep(volumes: DataFrame, directions: tuple[int, ...] = SWEEP_DIRECTIONS, lines: tuple[int, ...] = SWEEP_LINES, repetitions: int = SWEEP_REPETITIONS, increment: float = intercepts.INCREMENT, seed: int = intercepts.SEED) -> DataFrame:
    """One quadric for each specimen, direction count, line count and repetition.

    Settings come to the volumes: a task takes a few volumes at a time and makes one setting after the other of
    them. Volumes of one domain share a setting's lines and are sampled together, and settings that differ
    in directions alone share theirs.
    """
    kind = volumes.schema["specimen"].dataType.simpleString()
    ddl = f"specimen {kind}, rep int, directions int, lines int, {_QUADRIC}, status string, error string"
    target = to_arrow_schema(StructType.fromDDL(ddl))
    names = ["specimen", "width", "height", "depth", "bone", "roi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, intercepts.TOGETHER):
                part = b.slice(at, intercepts.TOGETHER)
                rows = [r | {"specimen": i} for i, r in _quadrics(part, directions, lines, repetitions, increment, seed)]
                specimens = part.column(0).take(pa.array([r["specimen"] for r in rows], pa.int32()))
                yield pa.RecordBatch.from_arrays([specimens, *[pa.array([r.get(f.name) for r in rows], f.type) for f in list(target)[1:]]], schema=target)

    return volumes.select(*names).mapInArrow(run, ddl)


def _quadrics(b: pa.RecordBatch, directions: tuple[int, ...], lines: tuple[int, ...], repetitions: int, increment: float, seed: int) -> Iterator[tuple[int, dict]]:
    """(row of b, result) for each setting. Every direction gives a point, in the order of the stream, so the points of
    fewer directions are the first of those of the most."""
    groups: dict[tuple, list[int]] = {}
    bits: dict[tuple, np.ndarray] = {}
    for i in range(b.num_rows):
        width, height, depth, bone, roi = (b.column(k)[i].as_py() for k in range(1, 6))
        at = (depth, height, width)
        try:
            inside = unpack(roi, at) if roi is not None else np.ones(at, bool)
            square = intercepts.domain(inside)
        except MorphometryError as why:
            for m, rep, n in product(lines, range(repetitions), directions):
                yield i, {"rep": rep, "lines": m, "directions": n, "status": "FAIL", "error": str(why)}
            continue
        held = groups.setdefault((at, square), [])
        here = bits.setdefault((at, square), np.zeros(at, np.uint8))
        here |= voxels.phase(unpack(bone, at), inside, True).astype(np.uint8) << np.uint8(len(held))
        held.append(i)
    for (key, held), m, rep in product(groups.items(), lines, range(repetitions)):
        (depth, _, _), square = key
        for i, points in zip(held, intercepts.clouds(bits[key], len(held), square, seed, rep, max(directions), m, increment), strict=True):
            for n in directions:
                try:
                    found = intercepts.anisotropy(points[:n]) | {"side": square[2], "depth": depth, "status": "OK"}
                except MorphometryError as problem:
                    found = {"status": "FAIL", "error": str(problem)}
                yield i, found | {"rep": rep, "lines": m, "directions": n}


def anisotropy(volumes: DataFrame, **options) -> DataFrame:
    """Degree of anisotropy over repetitions: mean, deviation, coefficient of variation, range."""
    v = F.col("da")
    reps = anisotropy_repetitions(volumes, **options).filter("status = 'OK'")
    sd = F.coalesce(F.stddev_samp(v), F.lit(0.0))
    return reps.groupBy("specimen").agg(
        F.count("*").alias("repetitions"), F.avg(v).alias("da_mean"), sd.alias("da_sd"), F.when(F.avg(v) != 0, F.abs(sd) / F.abs(F.avg(v))).otherwise(float("nan")).alias("da_cv"),
        F.min(v).alias("da_min"), F.max(v).alias("da_max"), F.avg("angle_deg").alias("angle_mean"), F.avg("radius_a").alias("radius_a"), F.avg("radius_b").alias("radius_b"), F.avg("radius_c").alias("radius_c"),
        F.first("side").alias("side"), F.first("depth").alias("depth"),
    )


def run(volumes: DataFrame, kernel, schema: str, on_error: str = "keep") -> DataFrame:
    return per_specimen(volumes, kernel, schema, on_error)
