"""Each query against its DuckDB twin, and the others for their status."""

import os

import duckdb
import pandas as pd
import pytest

from voxloom.plans import catalog

TABLES = "part lineitem orders supplier customer nation region events".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return "none"
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf_dir, con, name):
    ours, theirs = catalog.QUERIES[name](spark, sf_dir).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir).toPandas()
    assert len(df)
    if "status" in df:
        assert df["status"].isin(["OK", "PASS"]).all(), df["error"].dropna().unique()


def test_foam_reaches_every_descriptor(spark):
    soi = catalog.QUERIES["soi"](spark, "/root/testdata/sf0.01").toPandas()
    assert (soi["n_plate"] >= 25).all() and (soi["n_rod"] >= 25).all()
    assert soi[["p_o", "r_o", "pr_o", "soi", "plate_misorientation", "rod_misorientation", "orthogonality_deviation"]].notna().all(axis=None)
    axial = catalog.QUERIES["axial_graph_foam"](spark, "/root/testdata/sf0.01").toPandas()
    assert (axial["status"] == "OK").mean() >= 0.9
