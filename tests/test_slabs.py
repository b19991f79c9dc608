"""Slabs against whole volumes: components, Betti numbers, spanning and distances at any slab size."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxloom.functions import layers as L
from voxloom.functions import surfaces
from voxloom.functions import voxels as V
from voxloom.operators import measures as M
from voxloom.operators import slabs as S
from voxloom.operators import unions
from voxloom.operators.specimens import pack, slices
from voxloom.plans import fixtures as X
from voxloom.sources import tiff


def figures():
    """The figures of the topology tests: voxel, bar, frame, corner, pairs, hollow cube; noise; full and empty."""
    v = lambda n, *at: np.isin(np.arange(n**3).reshape(n, n, n), [(z * n + y) * n + x for z, y, x in at])
    frame = np.zeros((9, 9, 9), bool)
    for a in (2, 6):
        for b in (2, 6):
            frame[2:7, a, b] = frame[a, 2:7, b] = frame[a, b, 2:7] = True
    hollow = np.zeros((5, 5, 5), bool)
    hollow[1:4, 1:4, 1:4] = True
    hollow[2, 2, 2] = False
    out = [v(5, (2, 2, 2)), v(5, (1, 1, 1), (1, 1, 2)), frame, v(5, (0, 0, 0)), v(5, (1, 1, 1), (2, 2, 2)), v(5, (1, 1, 1), (3, 3, 3)), hollow]
    rng = np.random.default_rng(4)
    out += [rng.random(shape) < p for p in (0.1, 0.3, 0.5, 0.7, 0.95) for shape in ((8, 6, 7), (13, 5, 9), (2, 3, 2))]
    spiral = np.zeros((12, 7, 7), bool)
    for z in range(0, 12, 2):
        spiral[z, 1:6, 1:6] = True
        spiral[z + 1, 1 if z % 4 else 5, 3] = True
    return [*out, spiral, ~spiral, np.ones((4, 4, 4), bool), np.zeros((4, 4, 4), bool)]


FIGURES = figures()


@pytest.mark.parametrize("k", range(len(FIGURES)))
def test_runs_label_as_voxels(k):
    v = FIGURES[k]
    for connectivity in (6, 26):
        names, n = V.label(v, connectivity)
        runs = L.label_runs(v, connectivity)
        assert runs.parts == n
        ours = np.zeros(v.shape, int)
        for z, y, low, high, part in zip(runs.z, runs.y, runs.low, runs.high, runs.part, strict=True):
            ours[z, y, low : high + 1] = part + 1
        assert ((ours > 0) == v).all() and len(set(zip(ours[v].tolist(), names[v].tolist(), strict=True))) == n


@pytest.mark.parametrize("k", range(len(FIGURES)))
def test_cells_are_owned_once(k):
    v = FIGURES[k]
    m = V.cubical_measures(v)
    for layers in (1, 2, 3, 7, 20):
        got = sum(np.array(L.cell_counts(v[max(0, z - 1) : z + layers], int(z > 0), z + layers >= len(v))) for z in range(0, len(v), layers))
        assert got.tolist() == [m["vertices"], m["edges"], m["faces"], m["cubes"]]


def test_envelope_is_the_minimum():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 64):
        for high in (3, 50, 4000):
            f = rng.integers(0, high, (n, 200)).astype(np.int32)
            f[rng.random(f.shape) < 0.4] = L.FAR
            f[:, :5] = L.FAR
            want = np.minimum(V.min_plus(f.astype(np.int64), 0), L.FAR)
            assert (L.envelope(f) == want).all()


def test_row_distance():
    v = np.random.default_rng(6).random((40, 30)) < 0.8
    v[3], v[4] = True, False
    want = V.min_plus(np.where(v, np.int64(1) << 40, 0), 1)
    assert (L.row_distance(v) == np.minimum(want, L.FAR)).all()


def volumes(spark, figures):
    rows = [(k, *v.shape[::-1], 25.0, pack(v), None) for k, v in enumerate(figures)]
    return spark.createDataFrame(rows, "specimen int, width int, height int, depth int, h_um double, bone binary, roi binary")


@pytest.mark.parametrize("layers", [1, 3, 7, 50])
def test_topology_of_slabs(spark, layers):
    got = {r["specimen"]: r for r in S.topology(S.from_volumes(volumes(spark, FIGURES), layers)).collect()}
    assert len(got) == len(FIGURES)
    for k, v in enumerate(FIGURES):
        r = got[k]
        assert (r["bone_voxels"], r["euler"]) == (v.sum(), V.cubical_measures(v)["euler"])
        assert (r["b0"], r["b1"], r["b2"]) == V.betti(v), k
        assert r["spans"] == V.spans(v), k


@pytest.mark.parametrize("layers,block", [(1, 1), (7, 300), (50, 1 << 24)])
def test_distances_of_slabs(spark, layers, block):
    some = [v for v in FIGURES if not v.all()]
    found = S.squared_distance(S.from_volumes(volumes(spark, some), layers), layers, block).collect()
    for k, v in enumerate(some):
        parts = sorted((r["z0"], r) for r in found if r["specimen"] == k)
        d2 = np.concatenate([np.frombuffer(r["d2"], "<i4").reshape(r["layers"], r["height"], r["width"]) for _, r in parts])
        assert (d2 == V.squared_distance(v)).all()


@pytest.mark.parametrize("layers,around", [(1, 0), (3, 2), (50, 1)])
def test_balls_of_slabs(spark, layers, around):
    some = [v for v in FIGURES if not v.all()]
    found = S.ridge_balls(S.from_volumes(volumes(spark, some), layers), layers, 500, around).collect()
    for k, v in enumerate(some):
        d2 = V.squared_distance(v)
        want = V.propagate(d2, V.distance_ridge(d2))
        rows = sorted((r["z0"], r) for r in found if r["specimen"] == k)
        assert sum(r["layers"] for _, r in rows) == len(v)
        for z, r in rows:
            got = np.frombuffer(r["r2"], "<i4").reshape(-1, r["height"], r["width"])
            assert (got == want[z - r["below"] : z + r["layers"] + r["above"]]).all()


def test_thickness_of_slabs(spark, sf_dir):
    vols = X.volumes(spark, sf_dir).limit(4).cache()
    theirs = M.run(vols, M.thickness(True), M.DISTRIBUTION).toPandas().set_index("specimen").sort_index()
    for layers in (5, 24):
        ours = S.thickness(S.from_volumes(vols, layers), layers, 3000).toPandas().set_index("specimen").sort_index()
        np.testing.assert_allclose(ours[["mean", "sd", "max"]], theirs[["mean", "sd", "max"]], rtol=1e-12)


@pytest.mark.parametrize("layers", [1, 4, 50])
def test_surfaces_of_slabs(spark, layers):
    got = {r["specimen"]: r for r in S.surface(S.from_volumes(volumes(spark, FIGURES), layers)).collect()}
    for k, v in enumerate(FIGURES):
        vertices, triangles = surfaces.isosurface(-np.pad(v, 1).astype(float), -0.5)
        r = got[k]
        assert (r["vertices"], r["triangles"]) == (len(vertices), len(triangles)), k
        assert r["area"] == pytest.approx(surfaces.binary_area(v, 25.0)) and r["midpoint_area"] == pytest.approx(surfaces.binary_area(v, 25.0, "middle"))


def test_a_full_volume_has_no_distance(spark):
    with pytest.raises(Exception, match="opposite phase"):
        S.squared_distance(S.from_volumes(volumes(spark, [np.ones((4, 4, 4), bool)]), 2)).collect()


def test_slabs_of_pages(spark, sf_dir):
    vols = X.volumes(spark, sf_dir).cache()
    layers = slices(vols).withColumn("h_um", F.lit(25.0))
    ours = S.topology(S.from_pages(layers, 7)).toPandas().set_index("specimen").sort_index()
    theirs = M.run(vols, M.betti, M.BETTI).toPandas().set_index("specimen").sort_index()
    pd.testing.assert_frame_equal(ours[["b0", "b1", "b2", "spans"]], theirs[["b0", "b1", "b2", "spans"]])
    assert S.from_pages(layers.withColumn("roi", F.lit(None).cast("binary")), 8).count() == 3 * vols.count()
    with pytest.raises(Exception, match="no volume"):
        S.from_pages(layers.filter("z <> 5"), 7).collect()


def test_slabs_from_a_tiff_file(spark, tmp_path):
    v = np.random.default_rng(8).random((30, 16, 16)) < 0.3
    (tmp_path / "a.tif").write_bytes(tiff.write(v, 20.0))
    tiff.register(spark)
    pages = spark.read.format("voxel_tiff").option("split_bytes", 3000).load(str(tmp_path)).selectExpr("path AS specimen", "z", "width", "height", "x_um AS h_um", "voxels AS bone", "CAST(NULL AS BINARY) AS roi")
    r = S.topology(S.from_pages(pages, 4)).first()
    assert (r["b0"], r["b1"], r["b2"]) == V.betti(v)


def test_components_of_many_graphs(spark):
    rng = np.random.default_rng(9)
    edges = [(g, int(a), int(b)) for g in range(4) for a, b in rng.integers(0, 60, (40, 2))]
    edges += [(9, k, k + 1) for k in range(200)] + [(10, 0, k) for k in range(1, 300)] + [(11, 5, 5)]
    got = {(r["g"], r["node"]): r["component"] for r in unions.components(spark.createDataFrame(edges, "g int, a long, b long"), ["g"]).collect()}
    want = {}
    for g in {e[0] for e in edges}:
        own = [(a, b) for k, a, b in edges if k == g and a != b]
        root = {n: n for e in own for n in e}
        for _ in root:
            for a, b in own:
                root[a] = root[b] = min(root[a], root[b])
        want |= {(g, n): r for n, r in root.items()}
    assert got == want


def test_balls_of_many_slabs_together():
    rng = np.random.default_rng(10)
    some = [rng.random((6, 9, 8)) < p for p in (0.5, 0.7, 0.9, 0.98, 0.995)]
    d2 = np.stack([V.squared_distance(v) for v in some]).astype(np.int32)
    points = L.ridge_points(d2, slice(0, 6))
    painted = L.paint_balls(d2.shape, points)
    for k in range(len(some)):
        ridge = V.distance_ridge(d2[k])
        assert (np.argwhere(ridge) == points[points[:, 0] == k, 1:4]).all()
        assert (painted[k] == V.propagate(d2[k], ridge)).all()
    inner = L.ridge_points(d2, slice(2, 4))
    assert (inner == points[(points[:, 1] >= 2) & (points[:, 1] < 4)][np.argsort(points[(points[:, 1] >= 2) & (points[:, 1] < 4), 1], kind="stable")]).all()


def test_small_slabs_are_taken_together():
    n = 5000
    names = ["z0", "layers", "below", "depth", "width", "height"]
    small = [[7 * (k % 2), 7, k % 2, 24, 24, 24] for k in range(n)]
    large = [[0, 16, 0, 900, 700, 800]] * 3
    rows = pa.record_batch([pa.array(c, pa.int32()) for c in zip(*small, *large, strict=True)], names=names)
    taken = list(S._alike(rows, names))
    assert sorted(np.concatenate([at for _, at in taken]).tolist()) == list(range(n + 3))
    assert [len(at) for place, at in taken if place["width"] == 700] == [1, 1, 1]
    assert len(taken) - 3 <= 2 + n * 7.5 * 24 * 24 / S.TOGETHER * 1.1  # not one by one
    for place, at in taken:
        assert all([c[i].as_py() for c in rows.columns] == [place[k] for k in names] for i in at[[0, -1]])
        assert len(at) == 1 or len(at) * S._voxels(place) <= S.TOGETHER


def test_groups_go_over_batches():
    rng = np.random.default_rng(11)
    keys = [(s, z) for s in ("a", "b", None, "c") for z in range(5)]
    rows = [(s, z, k) for s, z in keys for k in range(rng.integers(1, 9))]
    whole = pa.record_batch([pa.array([r[i] for r in rows]) for i in range(3)], names=["specimen", "z0", "k"])
    for cuts in ([], range(1, len(rows)), [0, 0, 3, 3, 40], sorted(rng.integers(0, len(rows), 12).tolist())):
        ends = [*cuts, len(rows)]
        batches = [whole.slice(a, b - a) for a, b in zip([0, *ends], ends)]  # noqa: B905
        got = []
        for part, begins in S._groups(iter(batches), ["specimen", "z0"]):
            got += [part.slice(a, b - a).to_pydict() for a, b in zip(begins, [*begins[1:], part.num_rows], strict=True)]
        assert [(set(g["specimen"]), set(g["z0"])) for g in got] == [({s}, {z}) for s, z in keys]
        assert [(s, z, k) for g in got for s, z, k in zip(*g.values(), strict=True)] == rows


def test_balls_of_slabs_with_names(spark):
    """Volumes of several sizes, known by strings, more than one to a task: dealt by sorted rows, not by lists."""
    some = [v for v in FIGURES if not v.all()] * 3
    rows = [(f"s{k}", *v.shape[::-1], 25.0, pack(v), None) for k, v in enumerate(some)]
    vols = spark.createDataFrame(rows, "specimen string, width int, height int, depth int, h_um double, bone binary, roi binary")
    found = S.ridge_balls(S.from_volumes(vols, 3), 3, 100)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    counts = {}
    for r in S.value_counts(found, "r2").collect():
        counts.setdefault(r["specimen"], {})[r["d2"]] = r["n"]
    for k, v in enumerate(some):
        d2 = V.squared_distance(v)
        values, n = np.unique(V.propagate(d2, V.distance_ridge(d2)), return_counts=True)
        assert counts.get(f"s{k}", {}) == {a: b for a, b in zip(values.tolist(), n.tolist(), strict=True) if a}


def test_surfaces_of_many_images_are_cleaned_together():
    """Bit for bit the sums in the order of the offsets, for one image and for several at once."""
    rng = np.random.default_rng(12)
    t = np.where(rng.random((4, 7, 8, 6)) < 0.9, rng.random((4, 7, 8, 6)) * 9, 0).astype(np.float32)
    t[3] = 2.5
    got = V.clean_surface(t)
    for k, one in enumerate(t):
        surface = np.any([V.shifted(one, o, np.float32(-1)) == 0 for o in V.OFFSETS26], axis=0) & (one > 0)
        inner = np.where((one > 0) & ~surface, one, np.float32(0))
        total, count = np.zeros_like(inner), np.zeros(one.shape, np.int32)
        for o in V.OFFSETS26:
            total += V.shifted(inner, o, np.float32(0))
            count += V.shifted(inner, o, np.float32(0)) > 0
        want = np.where(surface & (count > 0), total / np.maximum(count, 1).astype(np.float32), one)
        assert got[k].dtype == np.float32 and (got[k] == want).all() and (V.clean_surface(one) == want).all()


def test_thickness_of_many_small_slabs(spark):
    """Volumes of several sizes, many to a task, in slabs that differ in the layers around them."""
    some = [v for v in FIGURES if not v.all()] * 2
    ours = {r["specimen"]: r for r in S.thickness(S.from_volumes(volumes(spark, some), 3), 3, 100).collect()}
    for k, v in enumerate(some):
        t = V.local_thickness(v)
        if not v.any():
            assert k not in ours
            continue
        want = V.distribution(t, 25.0, quantiles=False)
        assert ours[k]["n"] == np.count_nonzero(t)
        np.testing.assert_allclose([ours[k][c] for c in ("mean", "sd", "max")], [want[c] for c in ("mean", "sd", "max")], rtol=1e-6)


@pytest.mark.parametrize("axis", [0, 1, 2])
def test_nearest_is_the_minimum(axis):
    """Short offsets and, for lines that they leave open, the envelope: lines shorter and longer than the offsets."""
    rng = np.random.default_rng(13)
    for n in (1, 2, L.OFFSETS + 1, 60):
        for high, share in ((3, 0.1), (3, 0.97), (5000, 0.9)):
            f = rng.integers(0, high, (n, 14, 15)).astype(np.int32)
            f[rng.random(f.shape) < share] = L.FAR
            f[:, 0] = L.FAR
            f = np.moveaxis(f, 0, axis)
            want = np.minimum(V.min_plus(f.astype(np.int64), axis), L.FAR)
            got = L.nearest(f, axis)
            assert got.dtype == np.int32 and (got == want).all()


def test_row_distance_along_every_axis():
    v = np.random.default_rng(14).random((9, 20, 7)) < 0.9
    v[:, :, 3] = True
    for axis in range(3):
        want = np.minimum(V.min_plus(np.where(v, np.int64(1) << 40, 0), axis), L.FAR)
        assert (L.row_distance(v, axis) == want).all()


def test_values_of_many_slabs_are_counted_together():
    """Slabs of one shape are one output batch, each with its own counts of its own layers."""
    rng = np.random.default_rng(15)
    d2 = rng.integers(0, 4, (50, 5, 6, 7)).astype("<i4")
    slab, values, n = S._counted(d2[:, 1:4], d2[:, 1:4] > 0)
    got = {(s, v): k for s, v, k in zip(slab.to_pylist(), values.tolist(), n.tolist(), strict=True)}
    assert got == {(s, v): int((d2[s, 1:4] == v).sum()) for s in range(50) for v in (1, 2, 3)}


def test_distances_move_bits_and_then_distances(spark):
    """Two shuffles, and no piece is held in a list of a group."""
    some = [v for v in FIGURES if not v.all()] * 4
    found = S.squared_distance(S.from_volumes(volumes(spark, some), 3), 3, 40, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "collect_list" not in plan
    for r in found.collect():
        want = V.squared_distance(some[r["specimen"]])[r["z0"] - r["below"] : r["z0"] + r["layers"] + r["above"]]
        assert (np.frombuffer(r["d2"], "<i4").reshape(want.shape) == want).all()
