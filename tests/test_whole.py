"""Queries do their whole job: every specimen, the full grids and counts."""

from itertools import product

import numpy as np
import pytest

from voxloom.functions import intercepts
from voxloom.operators import measures as M
from voxloom.plans import catalog
from voxloom.plans import fixtures as X


def test_orientation_density(spark, sf_dir):
    df = catalog.QUERIES["orientation_density"](spark, sf_dir).toPandas()
    specimens = {r[0] for r in X.balls(spark, sf_dir).select("specimen").distinct().collect()}
    assert set(df["specimen"]) == specimens and (df.groupby("specimen").size() == 361 * 181).all()
    # every tenth node of the first specimen is the grid of 5 degrees that the SQL holds
    few = df[(df["specimen"] == 0) & (df["i"] % 10 == 0) & (df["j"] % 10 == 0)]
    ours = {(r.i // 10, r.j // 10): r.pdf for r in few.itertuples()}
    theirs = {(r.i, r.j): r.pdf for r in catalog.QUERIES["orientation_kde"](spark, sf_dir).filter("specimen = 0").collect()}
    assert ours.keys() == theirs.keys() and all(ours[k] == pytest.approx(v, abs=1e-6) for k, v in theirs.items())
    edge = lambda k, n: np.where((k == 0) | (k == n), 0.5, 1.0)
    total = (df["pdf"] * edge(df["i"], 360) * edge(df["j"], 180)).groupby(df["specimen"]).sum() * np.radians(0.5) ** 2
    assert np.allclose(total, 1, atol=0.02)


def test_sweep(spark, sf_dir):
    df = catalog.QUERIES["da_convergence"](spark, sf_dir).toPandas()
    specimens = {r[0] for r in X.balls(spark, sf_dir).select("specimen").distinct().collect()}
    wanted = {(s, d, k) for s in specimens for d in (64, 128, 256, 512, 1024, 2048) for k in (8, 16, 32, 64, 128)}
    assert {(r.specimen, r.directions, r.lines) for r in df.itertuples()} == wanted and (df["runs"] == 3).all()


def test_kept_lines_change_nothing(monkeypatch):
    bone = np.random.default_rng(0).random((20, 18, 18)) < 0.3
    kept = [intercepts.cloud(bone & keep, (2, 2, 14), 7, 1, 20, 16) for keep in (True, bone[::-1])]
    monkeypatch.setattr(intercepts, "KEPT_SAMPLES", 0)
    for a, keep in zip(kept, (True, bone[::-1]), strict=True):
        assert np.array_equal(a, intercepts.cloud(bone & keep, (2, 2, 14), 7, 1, 20, 16))


def test_volumes_sampled_together():
    found = np.random.default_rng(1).random((8, 20, 18, 18)) < 0.4
    found[0] = False
    bits = np.zeros(found.shape[1:], np.uint8)
    for k, v in enumerate(found):
        bits |= v.astype(np.uint8) << np.uint8(k)
    for lines in (5, 70):  # up to some thousand samples a direction, more than a byte counts
        together = intercepts.clouds(bits, 8, (2, 2, 14), 7, 1, 20, lines)
        assert all(np.array_equal(a, intercepts.cloud(v, (2, 2, 14), 7, 1, 20, lines)) for a, v in zip(together, found, strict=True))


def test_lines_of_a_sweep_are_drawn_once():
    intercepts._kept_lines.cache_clear()
    for _, lines, rep in product(range(2), M.SWEEP_LINES, range(M.SWEEP_REPETITIONS)):
        intercepts.clouds(np.ones((6, 6, 6), np.uint8), 1, (0, 0, 6), 7, rep, 10, lines)
    assert intercepts._kept_lines.cache_info().misses == len(M.SWEEP_LINES) * M.SWEEP_REPETITIONS


def test_doubles_are_those_of_the_stream():
    a, b = intercepts.SplitMix64(intercepts.SEED), intercepts.Doubles(intercepts.SEED)
    assert [a.double() for _ in range(9000)] == [b.double() for _ in range(9000)]


@pytest.mark.parametrize("name", ["w102", "curvature_stats"])
def test_every_wide_specimen(spark, sf_dir, name):
    parts = X.table(spark, sf_dir, "part").count()
    df = catalog.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(df["specimen"]) == list(range(-(-parts // 120)))


def test_default_counts(spark, sf_dir):
    points = catalog.QUERIES["mil_points"](spark, sf_dir).toPandas()
    assert (points.groupby(["specimen", "rep"]).size() == 1024).all() and set(points["rep"]) == set(range(5))
    fits = catalog.QUERIES["quadric_fit"](spark, sf_dir).toPandas()
    assert len(fits) == 5 * points["specimen"].nunique() and len(catalog.QUERIES["radii_check"](spark, sf_dir).toPandas()) == len(fits)
    again = points[(points["specimen"] == 1) & (points["rep"] == 3)][["mx", "my", "mz"]].to_numpy()
    fit = fits[(fits["specimen"] == 1) & (fits["rep"] == 3)].iloc[0]
    assert fit["da"] == pytest.approx(intercepts.anisotropy(again)["da"], abs=1e-12)
    da = fits.groupby("specimen")["da"].mean()
    da_mean = catalog.QUERIES["degree_of_anisotropy"](spark, sf_dir).toPandas().set_index("specimen")
    assert (da_mean["repetitions"] == 5).all() and np.allclose(da_mean["da_mean"].sort_index(), da, atol=1e-12)
    column = "DA mean (native MIL candidate)"
    for name in ("schema_standard", "families_core"):
        df = catalog.QUERIES[name](spark, sf_dir).toPandas()
        found = next(c for c in df.columns if c in (column, "da_mean", "paper_morphometry.DA_mean"))
        assert np.allclose(np.sort(df[found].astype(float)), np.sort(da), atol=1e-9)


def test_parity_of_many_suppliers(spark, tmp_path):
    keys = range(2345)
    spark.createDataFrame([(k, k / 7) for k in keys], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = catalog.QUERIES["parity_report"](spark, str(tmp_path)).collect()
    assert sorted((r["code"], r["pass"]) for r in rows) == sorted((f"QC{k % 1000:03d}", k % 10 != 0) for k in keys)


def test_window_points(spark, sf_dir):
    got = catalog.QUERIES["window_points"](spark, sf_dir).toPandas()
    seeds = X.balls(spark, sf_dir).toPandas().set_index("ball")
    at = got.join(seeds, on="seed", rsuffix="_seed")
    assert (at["specimen"] == at["specimen_seed"]).all() and all(((at[c] - at["c" + c]).abs() <= 4).all() for c in "xyz")
    assert not got.duplicated().any()
    n = {r["seed"]: r["n"] for r in catalog.QUERIES["window_moments"](spark, sf_dir).collect()}
    assert got.groupby("seed").size().to_dict() == n


@pytest.mark.parametrize("name", ["orientation_kde", "bv_tv", "phase_inside", "input_qc", "neighbours6", "degree26"])
def test_rows_that_are_many_are_not_moved(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(X, "TASK_SPECIMENS", 1)
    parts = X.table(spark, sf_dir, "part").count()
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # only the balls are dealt, to as many tasks as there are specimens
    assert plan.count("Exchange hashpartitioning") == 1 and f", {max(4, -(-parts // X.PARTS))}), REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("name", ["window_points", "window_moments", "eigh3"])
def test_windows_are_dealt_to_more_tasks_where_tables_grow(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(X, "TASK_SPECIMENS", 1)
    tasks = X.tasks_of(X.table(spark, sf_dir, "part"))
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert tasks > 4 and plan.count(f", {tasks}), REPARTITION_BY_NUM") == 4
