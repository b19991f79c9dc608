"""Sources, configuration, report schemas, stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom import __main__ as cli
from voxloom.operators import report
from voxloom.operators.parity import compare, families
from voxloom.operators.specimens import check, from_slices, slices, voxels
from voxloom.plans import fixtures, job
from voxloom.session import Config, ConfigError
from voxloom.sources import spacing, tiff
from voxloom.streaming.ingest import measure_stream


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("vol")
    rng = np.random.default_rng(0)
    for sub in ("bone", "roi"):
        (root / sub / "a").mkdir(parents=True)
    for k in range(3):
        centres = [(*rng.integers(0, 24, 3), int(rng.integers(2, 5))) for _ in range(40)]
        (root / f"bone/a/QC00{k}.tif").write_bytes(tiff.write(fixtures.paint(centres), 25.0))
        (root / f"roi/a/QC00{k}.tif").write_bytes(tiff.write(fixtures.region()))
    (root / "spacing.csv").write_text("filename, spacing_micrometers, note\n" + "".join(f" qc00{k}.TIF , {20 + k}, x\n" for k in range(3)))
    return root


def test_tiff_source(spark, folder):
    tiff.register(spark)
    df = spark.read.format("voxel_tiff").option("samples", "strict").load(str(folder / "bone"))
    assert df.groupBy("path").count().filter("count = 24").count() == 3
    assert df.filter("abs(x_um - 25) > 1e-6 OR abs(z_um - 25) > 1e-9").isEmpty()


def test_tiff_rules():
    v = np.zeros((2, 3, 4), bool)
    v[0, 1, 2] = True
    data = tiff.write(v, 20.0)
    found = list(tiff.read_pages(data, 0, "strict"))
    assert [p[:3] for p in found] == [(0, 4, 3), (1, 4, 3)] and tiff.isotropic(*found[0][3:6]) == pytest.approx(20)
    odd = bytearray(data)
    odd[8] = 7
    with pytest.raises(tiff.TiffError):
        list(tiff.read_pages(bytes(odd), 0, "strict"))
    with pytest.raises(tiff.TiffError):
        list(tiff.read_pages(b"nothing here"))
    with pytest.raises(tiff.TiffError):
        tiff.isotropic(20.0, 20.0, 21.0)
    with pytest.raises(tiff.TiffError):
        tiff.isotropic(None, 20.0, 20.0)
    # 25,400 micrometres an inch over a million dots
    assert tiff.spacing_um({tiff.RESUNIT: [2], tiff.XRES: [1e6], tiff.YRES: [1e6]})[0] == pytest.approx(0.0254)


def test_job(spark, folder, tmp_path):
    cfg = Config(binary_dir=str(folder / "bone"), roi_dir=str(folder / "roi"), mode="bonej")
    out = job.run(spark, cfg, str(tmp_path / "out.csv"))
    assert len(out.columns) == 14 and out.count() == 3
    assert spark.read.csv(str(tmp_path / "out.csv"), header=True).count() == 3
    table = Config(binary_dir=str(folder / "bone"), roi_dir=str(folder / "roi"), mode="bonej", spacing_csv=str(folder / "spacing.csv"))
    assert job.load(spark, table).select("h_um").distinct().count() == 3
    with pytest.raises(job.InputError):
        job.run(spark, Config(binary_dir=str(folder / "bone"), roi_dir=str(folder / "none") if (folder / "none").mkdir(exist_ok=True) is None else "", mode="bonej"))


def test_standard_and_families(spark, folder):
    small = {"da_directions": 32, "da_lines": 16, "da_repetitions": 2}
    base = {"binary_dir": str(folder / "bone"), "roi_dir": str(folder / "roi"), "continue_on_error": True} | small
    std = job.run(spark, Config(**base))
    assert len(std.columns) == 52 and std.count() >= 1
    fam = job.run(spark, Config(**base, preset="core"))
    assert fam.columns[1] == "paper_morphometry.BVTV" and len(fam.columns) == 14


def test_column_counts():
    n = {m: 1 + len(report.columns(m)) for m in report.MODES}
    assert n == {"bonej": 14, "classic": 13, "refined": 15, "experimental": 19, "standard": 52}
    assert 1 + len(report.columns("standard", True)) == 89
    assert 1 + len(report.columns(families=tuple(report.FAMILY_COLUMNS))) == 35


def test_config_rules():
    for bad in (
        {"mode": "bonej"}, {"mode": "standard"}, {"mode": "classic", "advanced": True}, {"mode": "classic", "preset": "core"}, {"roi_dir": "r", "advanced": True, "preset": "core"},
        {"roi_dir": "r", "da_directions": 8}, {"roi_dir": "r", "da_increment": 1.0}, {"roi_dir": "r", "ef_window_radius": 0}, {"roi_dir": "r", "curvature_sigma_um": 0.0},
        {"roi_dir": "r", "voxel_size": 1.0, "spacing_csv": "x"}, {"roi_dir": "r", "voxel_size": -1.0}, {"roi_dir": "r", "descriptors": ("nothing",)},
    ):
        with pytest.raises(ConfigError):
            Config(**bad).check()
    c = Config(roi_dir="r", descriptors=("soi", "paper", "soi")).check()
    assert c.families == ("soi", "paper") and c.strict
    assert Config(roi_dir="r", preset="manuscript").families == tuple(report.FAMILY_COLUMNS)
    assert Config(roi_dir="r", advanced=True, curvature_sigma_um=50.0).check().warnings
    assert cli.config(cli.parser().parse_args(["--binary-dir", "b", "--roi-dir", "r"])).da_seed == 4778124954572866625


def test_spacing_table(spark, tmp_path):
    good = tmp_path / "s.csv"
    good.write_text("﻿filename,spacing_micrometers,extra\n x/A.TIF , 25.5 ,1\n")
    assert [tuple(r) for r in spacing.read_table(spark, str(good)).collect()] == [("a.tif", 25.5)]
    for text in ("filename,spacing\na,1\n", "filename,spacing_micrometers\na.tif,1\nA.TIF,2\n", "filename,spacing_micrometers\na,-1\n", "filename,spacing_micrometers\na,x\n", "filename,spacing_micrometers\n"):
        bad = tmp_path / f"{abs(hash(text))}.csv"
        bad.write_text(text)
        with pytest.raises(spacing.SpacingError):
            spacing.read_table(spark, str(bad))


def test_description(spark):
    df = spark.createDataFrame([("ImageJ=1\nunit=micron\nspacing=2.5\n",), ("",)], "t string")
    got = df.select(spacing.description_value(F.col("t"), "spacing"), spacing.unit_scale(spacing.description_value(F.col("t"), "unit"))).collect()
    assert [tuple(r) for r in got] == [("2.5", 1.0), (None, None)]


def test_slices_round_trip(spark, sf_dir):
    v = fixtures.volumes(spark, sf_dir)
    layers = slices(v).join(v.select("specimen", "h_um"), "specimen")
    a = {r["specimen"]: bytes(r["bone"]) for r in v.collect()}
    assert {r["specimen"]: bytes(r["bone"]) for r in from_slices(layers).collect()} == a
    assert check(v).filter("problem IS NOT NULL").isEmpty()
    n = fixtures.bone_voxels(spark, sf_dir).count()
    assert voxels(v).filter("bone AND roi").count() == n


def test_parity(spark):
    a = spark.createDataFrame([("x_qc001.tif", 1.0), ("QC002.tif", float("nan")), ("qc003", 5.0), ("qc004", 1.0)], "filename string, v double")
    b = spark.createDataFrame([("QC001", 1.0 + 1e-9), ("QC002", float("nan")), ("QC003", 5.1)], "filename string, v double")
    got = {r["code"]: (r["pass"], r["missing"]) for r in compare(a, b, ["v"]).collect()}
    assert got == {"QC001": (True, None), "QC002": (True, None), "QC003": (False, None), "QC004": (False, "theirs")}
    rep = families(a, {"one": b, "two": b}, {"one": ["v"], "two": ["v", "w"]}).groupBy("family", "status").count().collect()
    assert {(r["family"], r["status"]) for r in rep} == {("one", "PASS"), ("one", "FAIL"), ("two", "SKIP")}


def test_stream(spark, folder, tmp_path):
    cfg = Config(mode="experimental")
    q = measure_stream(spark, str(folder / "bone"), str(tmp_path / "rows"), str(tmp_path / "check"), cfg, 2)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "rows")).filter("status = 'OK'").count() == 3
