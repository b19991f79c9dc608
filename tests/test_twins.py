"""Relational operators beside the array kernels that the descriptors use: both must say the same."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import fields, intercepts, networks, shape
from voxloom.operators import relational as R


def test_gini_and_quantiles(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(v), float(w)) for g in "ab" for v, w in zip(np.round(rng.gamma(2, 3, 700), 1), rng.integers(1, 5, 700), strict=True)] + [("c", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(7)
    got = {r["g"]: r["gini"] for r in R.gini(df, ["g"], "v").collect()}
    found = {(r["g"], r["q"]): r["value"] for r in R.weighted_quantiles(df, ["g"], "v", "w", (0.05, 0.5, 0.99)).collect()}
    for g in "abc":
        v, w = (np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2))
        assert got[g] == pytest.approx(networks.gini(v), abs=1e-12)
        # equal values are one point: their weights are summed before the shares are interpolated
        u = np.unique(v)
        for q, x in zip((0.05, 0.5, 0.99), fields.weighted_quantiles(u, np.array([w[v == k].sum() for k in u]), (0.05, 0.5, 0.99)), strict=True):
            assert found[g, q] == pytest.approx(x)
    assert R.gini(spark.createDataFrame([("z", None), ("z", -1.0), ("z", float("nan"))], "g string, v double"), ["g"], "v").first()["gini"] == 0.0


def test_running_crosses_ranges(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"), F.lit(1.0).alias("w"))
    rows = sorted((r["g"], r["v"], r["upto"], r["total"], r["before"]) for r in R.running(df, ["g"], "v", "w").collect())
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        assert [r[2] for r in own] == list(range(1, len(own) + 1)) and {r[3] for r in own} == {len(own)}
        assert [r[4] for r in own] == [None, *[r[1] for r in own[:-1]]]


def test_curvature_summary(spark):
    rng = np.random.default_rng(1)
    h, k, w = rng.normal(0, 0.1, 300), rng.normal(0, 0.01, 300), rng.random(300)
    got = R.curvature_summary(spark.createDataFrame([(0, *map(float, r)) for r in zip(h, k, w, strict=True)], "g int, h double, k double, w double"), ["g"], "h", "k", "w").first().asDict()
    kernel = fields.curvature_summary(h, k, w)
    assert all(got[c] == pytest.approx(kernel[c]) for c in got if c != "g")


def test_axes(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 3))
    v = np.concatenate([v, [[0, 0, 1], [0, 1, 0], [1, 0, 0], [0, -1, 0], [-1, 0, 0]]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "i int, x double, y double, z double")
    axis = [F.col(c) for c in "xyz"]
    theta, phi = R.axis_angles(*axis)
    for r in df.select("i", theta.alias("t"), phi.alias("p"), R.axis_sign(*axis).alias("s")).collect():
        u = v[r["i"]]
        assert (r["t"], r["p"]) == pytest.approx(shape.axis_angles(u)) and np.allclose(r["s"] * u, shape.canonical_axis(u))


def test_neighbour_fields(spark):
    rng = np.random.default_rng(3)
    n = 80
    at, v = rng.integers(0, 30, (n, 3)).astype(float), rng.normal(size=(n, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    kind = ["plate" if k % 2 else "rod" for k in range(n)]
    kernel = shape.orientation_field([{"x": a[0], "y": a[1], "z": a[2], "kind": k, "vector": u} for a, k, u in zip(at, kind, v, strict=True)], 1.0, 4.0)
    df = spark.createDataFrame([(0, i, kind[i], *map(float, at[i]), *map(float, v[i])) for i in range(n)], "specimen int, id int, kind string, x double, y double, z double, ux double, uy double, uz double")
    dot = F.least(F.abs(sum(F.col(f"u{c}_a") * F.col(f"u{c}_b") for c in "xyz")), F.lit(1.0))
    of = lambda k: df.filter(F.col("kind") == k).drop("kind")
    local = lambda a, b, angle, key: R.radius_pairs(of(a), of(b), 4.0 * shape.FIELD_RADIUS).filter("id_a <> id_b").groupBy(key).agg(F.avg(F.degrees(angle)).alias("m")).agg(F.avg("m")).first()[0]
    assert local("plate", "plate", F.acos(dot), "id_a") == pytest.approx(kernel["plate_misorientation"])
    assert local("rod", "rod", F.acos(dot), "id_a") == pytest.approx(kernel["rod_misorientation"])
    both = (local("plate", "rod", F.asin(dot), "id_a") + local("plate", "rod", F.asin(dot), "id_b")) / 2
    assert both == pytest.approx(kernel["orthogonality_deviation"])


def test_windows_and_representatives(spark):
    rng = np.random.default_rng(4)
    bone = rng.random((14, 14, 14)) < 0.3
    at = np.argwhere(bone)[:, ::-1]
    df = spark.createDataFrame([(0, *map(int, p)) for p in at], "specimen int, x int, y int, z int")
    kernel = {tuple(map(int, p)) for p in shape.grid_representatives(at, 90.0, 25.0)}
    assert {(r["x"], r["y"], r["z"]) for r in R.grid_representatives(df, 90.0, 25.0).collect()} == kernel
    seeds = spark.createDataFrame([(0, k, *map(int, at[k])) for k in range(0, len(at), 40)], "specimen int, seed int, sx int, sy int, sz int")
    for r in R.window_moments(seeds, df, 4).collect():
        x, y, z = at[r["seed"]]
        p = shape.window_points(bone, (z, y, x), 4, False)
        assert r["n"] == len(p) and sorted((r["mxx"] - r["mx"] ** 2 / r["n"], r["mzz"] - r["mz"] ** 2 / r["n"])) == pytest.approx(sorted(np.var(p, axis=0)[[0, 2]] * len(p)))


def test_touching_and_degrees(spark):
    rng = np.random.default_rng(5)
    v = rng.random((9, 8, 7)) < 0.4
    at = [tuple(map(int, p[::-1])) for p in np.argwhere(v)]
    df = spark.createDataFrame([(0, *p) for p in at], "specimen int, x int, y int, z int")
    pairs = {(r["x"], r["y"], r["z"], r["dx"], r["dy"], r["dz"]) for r in R.touching(df, R.OFFSETS6[3:]).collect()}
    assert pairs == {(r["x"], r["y"], r["z"], r["dx"], r["dy"], r["dz"]) for r in R.neighbour_pairs(df, df, R.OFFSETS6).collect()}
    degree = {(r["x"], r["y"], r["z"]): r["degree"] for r in R.degree26(df).collect()}
    assert degree == {p: sum(max(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for q in at) for p in at}


def test_edges_and_rays(spark):
    rng = np.random.default_rng(6)
    edges = [networks.Edge(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, 6, 40), rng.integers(0, 6, 40), rng.integers(0, 9, 40), strict=True)]
    simple = {}
    for e in edges:
        if e.u != e.v:
            simple.setdefault((min(e.u, e.v), max(e.u, e.v)), []).append(e.length)
    df = spark.createDataFrame([(e.u, e.v, e.length) for e in edges], "u int, v int, length double")
    got = {(r["u"], r["v"]): (r["multiplicity"], r["length"], r["conductance"]) for r in R.collapse_edges(df, []).collect()}
    assert got == {k: (len(x), min(x), pytest.approx(sum(1 / y for y in x if y > 0))) for k, x in simple.items()}
    low, high = np.zeros(3), np.full(3, 10.0)
    for _ in range(50):
        p, d = rng.uniform(-15, 25, 3), rng.normal(size=3)
        near, far = spark.range(1).select(*[c.alias(n) for c, n in zip(R.ray_box([F.lit(float(x)) for x in p], [F.lit(float(x)) for x in d], 0.0, 10.0), "ab", strict=True)]).first()
        ends = np.sort(np.stack([(low - p) / d, (high - p) / d]), axis=0)
        a, b = ends[0].max(), ends[1].min()
        assert (near, far) == ((None, None) if a > b or b < 0 else (pytest.approx(a), pytest.approx(b)))
    assert math.isfinite(intercepts.INCREMENT)
