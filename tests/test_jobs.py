"""The jobs: growing input, repeated runs, parts that cannot be used, the command line."""

import json
import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest

from jobs import cohort_report as C
from jobs import settings
from jobs import specimen_registry as S
from voxloom.operators import measures as M
from voxloom.operators import relational as R
from voxloom.plans import fixtures as X
from voxloom.session import ConfigError

COLUMNS = ["specimen", "parts", "complete", "bone_voxels", "euler", "status"]


@pytest.fixture(scope="module")
def parts(sf_dir):
    return pd.read_parquet(f"{sf_dir}/part.parquet")


def rows(df, columns=None):
    found = df.toPandas() if hasattr(df, "toPandas") else df
    found = found[columns or sorted(found.columns)]
    return sorted(map(tuple, found.astype(object).where(found.notna(), None).values.tolist()), key=str)


def whole(spark, parts):
    """Each specimen by the kernel, from all its parts at once."""
    table = spark.createDataFrame(parts[["p_partkey", "p_size"]])
    found = M.run(X.volumes_of(X.balls_of(table)), M.topology, M.TOPOLOGY).toPandas()
    n = parts.groupby(parts.p_partkey // 40).size()
    return sorted((int(s), int(n[s]), bool(n[s] == 40), int(b), int(e), "OK") for s, b, e in zip(found.specimen, found.bone_voxels, found.euler, strict=True))


def config(folder, **more):
    return S.Config(parts=f"file://{folder}/in", output=f"file://{folder}/out", checkpoint=f"file://{folder}/checkpoint", **more)


def test_registry_takes_only_what_is_new(spark, parts, tmp_path):
    cfg = config(tmp_path, block=2)
    (tmp_path / "in").mkdir()
    parts[parts.p_partkey < 90].to_parquet(tmp_path / "in/a.parquet")
    first = S.run(spark, cfg)
    assert rows(first, COLUMNS) == whole(spark, parts[parts.p_partkey < 90])
    assert first.filter("specimen = 2").first()["complete"] is False and {r["batch"] for r in first.collect()} == {0}
    files = lambda: {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "out") for f in fs if f.startswith("part-")}
    before = files()

    parts[parts.p_partkey >= 90].to_parquet(tmp_path / "in/b.parquet")
    second = S.run(spark, cfg)
    assert rows(second, COLUMNS) == whole(spark, parts)
    batches = {r["specimen"]: r["batch"] for r in second.collect()}
    assert batches[0] == batches[1] == 0 and {b for s, b in batches.items() if s >= 2} == {1}
    assert before.items() <= files().items()  # nothing of the first run was written again
    assert sorted(r["batch"] for r in S.history(spark, cfg).filter("specimen = 2").collect()) == [0, 1]

    kept = files()
    third = S.run(spark, cfg)
    assert rows(third) == rows(second) and files() == kept


def test_registry_batch_is_repeated_safely(spark, parts, tmp_path):
    cfg = config(tmp_path)
    frame = spark.createDataFrame(parts[parts.p_partkey < 60][["p_partkey", "p_size"]])
    S.take(frame, 0, cfg)
    once = rows(S.history(spark, cfg))
    S.take(frame, 0, cfg)
    assert rows(S.history(spark, cfg)) == once
    assert spark.read.schema(S.PARTS).parquet(f"{cfg.output}/parts").count() == 60


def test_registry_revised_and_unusable_parts(spark, parts, tmp_path):
    cfg = config(tmp_path, files_per_batch=1)
    (tmp_path / "in").mkdir()
    some = parts[parts.p_partkey < 40][["p_partkey", "p_size"]].astype("Int64")
    bad = pd.DataFrame({"p_partkey": [None, -1, 7], "p_size": [3, 3, None]}).astype("Int64")
    kinds = {"p_partkey": "Int64", "p_size": "Int32"}
    pd.concat([some, bad]).astype(kinds).assign(extra="x", status="y", batch=9).to_parquet(tmp_path / "in/a.parquet")
    S.run(spark, cfg)
    held = spark.read.schema(S.PARTS).parquet(f"{cfg.output}/parts")
    assert sorted(r["problem"] for r in held.filter("block = -1").collect()) == ["no key", "no key", "no size"]
    changed = some.assign(p_size=some.p_size + 1)
    changed[changed.p_partkey < 20].astype(kinds).to_parquet(tmp_path / "in/b.parquet")
    found = S.run(spark, cfg)
    expected = pd.concat([changed[changed.p_partkey < 20], some[some.p_partkey >= 20]]).astype("int64")
    assert rows(found, COLUMNS) == whole(spark, expected)


def test_registry_of_nothing(spark, parts, tmp_path):
    (tmp_path / "in").mkdir()
    cfg = config(tmp_path)
    parts[:0].to_parquet(tmp_path / "in/a.parquet")
    assert S.run(spark, cfg).count() == 0
    with pytest.raises(ConfigError):
        S.run(spark, S.Config(parts="x", output="y"))


def test_report_repeats_and_replaces_some_cohorts(spark, parts, tmp_path):
    source, out = f"file://{tmp_path}/part.parquet", f"file://{tmp_path}/out"
    parts.to_parquet(tmp_path / "part.parquet")
    cfg = C.Config(parts=source, output=out, control="SMALL")
    once = rows(C.run(spark, cfg))
    assert rows(C.run(spark, cfg)) == once
    names = sorted({r[0] for r in once})
    path = tmp_path / "out/specimens"
    before = {d: os.listdir(path / d) for d in os.listdir(path) if d.startswith("cohort=")}
    assert names and len(before) >= 2
    pick = sorted(before)[0].split("=")[1]
    some = C.Config(parts=source, output=out, control="SMALL", cohorts=(pick,))
    assert rows(C.run(spark, some)) == once
    after = {d: os.listdir(path / d) for d in before}
    assert [d for d in before if sorted(before[d]) != sorted(after[d])] == [f"cohort={pick}"]


def test_report_statistics(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"cohort": ["a"] * 30 + ["b"] * 12 + ["c"], "specimen": range(43), "measure": "bv", "value": np.r_[rng.normal(5, 1, 29), 40.0, rng.normal(7, 2, 12), 1.0]})
    frame = spark.createDataFrame(data)
    summary = C.summarise(frame, "a")
    got = summary.toPandas().set_index("cohort")
    for name, own in data.groupby("cohort").value:
        assert np.allclose(got.loc[name, ["mean", "low", "q1", "median", "q3", "high"]].astype(float), [own.mean(), own.min(), *own.quantile([0.25, 0.5, 0.75]), own.max()])
    a, b = data[data.cohort == "a"].value, data[data.cohort == "b"].value
    va, vb = a.var() / len(a), b.var() / len(b)
    assert np.isclose(got.loc["b", "t"], (b.mean() - a.mean()) / np.sqrt(va + vb))
    assert np.isclose(got.loc["b", "df"], (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1)))
    assert np.isnan(got.loc["a", "t"]) and np.isnan(got.loc["c", "t"])
    assert [r["specimen"] for r in C.outliers(frame, summary, 1.5).filter("value = 40").collect()] == [29]


def test_quantiles_by_ranks(spark):
    rng = np.random.default_rng(6)
    data = pd.DataFrame({"g": rng.integers(0, 3, 5000), "v": np.round(rng.normal(size=5000), 1)})
    data.loc[data.g == 2, "v"] = 3.0
    more = pd.concat([data, pd.DataFrame({"g": [0, 9], "v": [np.nan, np.nan]})])
    qs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {(r["g"], r["q"]): r["value"] for r in R.quantiles(spark.createDataFrame(more), ["g"], "v", qs).collect()}
    assert got.keys() == {(g, q) for g in range(3) for q in qs}
    for g, own in data.groupby("g").v:
        assert np.allclose([got[g, q] for q in qs], own.quantile(list(qs)))


def test_report_unusable_parts_and_cohorts(spark, parts, tmp_path):
    some = parts[parts.p_partkey < 120].astype({"p_partkey": "Int64", "p_size": "Int32"})
    some.loc[some.p_partkey < 40, "p_type"] = None
    some.loc[(some.p_partkey >= 40) & (some.p_partkey < 80), "p_type"] = ""
    bad = some[:2].assign(p_partkey=[None, -5])
    pd.concat([some, bad]).assign(cohort="clash", status=1).to_parquet(tmp_path / "part.parquet")
    cfg = C.Config(parts=f"file://{tmp_path}/part.parquet", output=f"file://{tmp_path}/out")
    found = C.run(spark, cfg).toPandas()
    assert set(found[(found.kind == "specimen") & (found.cohort == "unknown")].specimen) == {0, 1}
    assert spark.read.parquet(f"{cfg.output}/rejected").count() == 2
    parts[:0].to_parquet(tmp_path / "none.parquet")
    assert C.run(spark, C.Config(parts=f"file://{tmp_path}/none.parquet", output=f"file://{tmp_path}/nothing")).count() == 0


def test_command_line(parts, tmp_path):
    (tmp_path / "in").mkdir()
    parts[parts.p_partkey < 40].to_parquet(tmp_path / "in/a.parquet")
    (tmp_path / "c.json").write_text(json.dumps({"parts": "elsewhere", "output": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/checkpoint", "block": 8}))
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-m", "jobs.specimen_registry", "--config", str(tmp_path / "c.json"), "--parts", str(tmp_path / "in")], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 40 parts" in done.stderr and "wrote 1 specimens" in done.stderr
    assert len(pd.read_parquet(tmp_path / "out/specimens")) == 1


def test_settings_are_checked(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"parts": "a", "colour": 1}))
    with pytest.raises(ConfigError, match="colour"):
        settings.read(spark, f"file://{tmp_path}/c.json", C.Config, {})
    (tmp_path / "c.json").write_text(json.dumps({"parts": "a", "cohorts": ["x"]}))
    assert settings.read(spark, f"file://{tmp_path}/c.json", C.Config, {"output": "b", "parts": None}) == C.Config(parts="a", output="b", cohorts=("x",))
