"""The batch job on damaged input, its CSV file, the parity command and the stream's keys."""

import csv
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom import compare
from voxloom.functions import fields, intercepts
from voxloom.functions.voxels import MorphometryError
from voxloom.operators import report
from voxloom.operators.specimens import from_slices
from voxloom.plans import fixtures, job
from voxloom.session import Config
from voxloom.sources import spacing, tiff
from voxloom.streaming.ingest import measure_stream


def scan(seed):
    rng = np.random.default_rng(seed)
    return tiff.write(fixtures.paint([(*rng.integers(0, 24, 3), int(rng.integers(2, 5))) for _ in range(40)]), 25.0)


@pytest.fixture
def folder(tmp_path):
    for sub in ("bone/a", "bone/b", "roi/a", "roi/b"):
        (tmp_path / sub).mkdir(parents=True)
    for k, name in enumerate(("a/QC001", "b/QC001", "a/QC002")):
        (tmp_path / f"bone/{name}.tif").write_bytes(scan(k))
        (tmp_path / f"roi/{name}.tif").write_bytes(tiff.write(fixtures.region()))
    return tmp_path


def damaged():
    good = scan(9)
    first = struct.unpack("<I", good[4:8])[0]
    cycle = bytearray(good)
    n = struct.unpack("<H", good[first : first + 2])[0]
    cycle[first + 2 + 12 * n : first + 6 + 12 * n] = struct.pack("<I", first)
    return {"short": good[: len(good) // 2], "cycle": bytes(cycle), "empty": b"", "text": b"no image", "far": good[:4] + b"\xff\xff\xff\x7f" + good[8:]}


@pytest.mark.parametrize("name", list(damaged()))
def test_damaged_files_are_tiff_errors(name):
    with pytest.raises(tiff.TiffError):
        tiff.read_volume(damaged()[name])


def test_continue_on_error(spark, folder, capsys):
    broken = {n: d for n, d in damaged().items() if d}  # files of length 0 are not listed
    for name, data in broken.items():
        (folder / f"bone/a/{name}.tif").write_bytes(data)
        (folder / f"roi/a/{name}.tif").write_bytes(tiff.write(fixtures.region()))
    (folder / "bone/a/alone.tif").write_bytes(scan(3))
    (folder / "bone/a/other.tif").write_bytes(scan(4))
    (folder / "roi/a/other.tif").write_bytes(tiff.write(fixtures.region(20)))
    cfg = Config(binary_dir=str(folder / "bone"), roi_dir=str(folder / "roi"), mode="bonej", continue_on_error=True)
    out = job.run(spark, cfg, str(folder / "out.csv"))
    assert [r["filename"] for r in out.collect()] == ["a/QC001.tif", "a/QC002.tif", "b/QC001.tif"]
    told = capsys.readouterr().err
    missed = [n for n in (*broken, "alone", "other") if f"failed: a/{n}.tif" not in told]
    assert not missed and "no region" in told and "differ in size" in told
    with open(folder / "out.csv") as f:
        rows = list(csv.reader(f))
    assert len(rows) == 4 and len(rows[0]) == 14 and not any("E" in v for r in rows[1:] for v in r[1:])
    number = {r["filename"]: r for r in out.collect()}
    assert all(float(v) == number[r[0]][c] for r in rows[1:] for c, v in zip(rows[0][1:], r[1:], strict=True))
    with pytest.raises(Exception, match="alone"):
        job.run(spark, Config(binary_dir=str(folder / "bone"), roi_dir=str(folder / "roi"), mode="bonej"))


def test_plain_decimals(spark):
    values = [2.698e-9, 1.23456785e7, 1.0, -1e-5, 1e22, -1.5e10, 0.1, 123.25, 0.0, 5e-324, 1.7976931348623157e308, float("nan"), None, 12345678.9]
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(report.plain_decimal(F.col("v"))).collect()]
    assert got[0] == "0.000000002698" and got[1] == "12345678.5" and got[2] == "1" and got[3] == "-0.00001" and got[4] == "1" + "0" * 22 and got[5] == "-15000000000" and got[11] == "NaN" and got[12] is None
    assert all("E" not in g and float(g) == v for g, v in zip(got, values, strict=True) if v is not None and v == v)


def test_kernels_run_in_parallel(spark, folder):
    """No exchange or coalesce to one task lies above the kernels of the written rows."""
    cfg = Config(binary_dir=str(folder / "bone"), roi_dir=str(folder / "roi"), mode="bonej")
    plan = report.analyse(job.load(spark, cfg), cfg.mode, cfg, "keep")._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "collect_list" not in plan


def test_stream_names_files_by_path(spark, folder):
    (folder / "bone/b/broken.tif").write_bytes(b"II*\0")
    q = measure_stream(spark, str(folder / "bone"), str(folder / "rows"), str(folder / "check"), Config(mode="experimental"), 10)
    q.awaitTermination(120)
    rows = {r["specimen"]: r for r in spark.read.parquet(str(folder / "rows")).collect()}
    assert set(rows) == {"a/QC001.tif", "b/QC001.tif", "a/QC002.tif", "b/broken.tif"} and rows["b/broken.tif"]["status"] == "FAIL"
    assert rows["a/QC001.tif"]["tv"] == rows["b/QC001.tif"]["tv"] == 24**3 * 25.0**3 and rows["a/QC001.tif"]["bv"] != rows["b/QC001.tif"]["bv"]


def test_layers_must_be_a_volume(spark):
    layer = lambda z: (1, z, 8, 2, 25.0, bytearray(2), bytearray(2))
    schema = "specimen int, z int, width int, height int, h_um double, bone binary, roi binary"
    assert from_slices(spark.createDataFrame([layer(1), layer(0)], schema)).first()["depth"] == 2
    for zs in ((0, 2), (0, 0, 1)):
        with pytest.raises(Exception, match="no volume"):
            from_slices(spark.createDataFrame([layer(z) for z in zs], schema)).collect()


def test_codes_of_several_files(spark):
    files = spark.createDataFrame([("x/QC001_bone.tif",), ("x/qc002.TIF",)], "path string")
    assert {r["code"] for r in spacing.by_code(files).collect()} == {"QC001", "QC002"}
    with pytest.raises(spacing.SpacingError, match="QC001"):
        spacing.by_code(files.unionAll(spark.createDataFrame([("y/QC001_binary.tiff",)], "path string")))


def test_parity_command(spark, tmp_path, capsys):
    columns = [c for f in ("skeleton", "minkowski") for c in compare.pairs(f)]
    values = {f"QC{k:03d}": [k + 0.1 * j for j in range(len(columns))] for k in range(1, 25)}

    def write(path, key, names, rows):
        with open(tmp_path / path, "w", newline="") as f:
            csv.writer(f).writerows([[key, *names], *rows])

    write("ours.csv", "filename", [a for a, _ in columns], [[f"x/{c.lower()}.tif", *v] for c, v in values.items()])
    write("skeleton.csv", "sample", [b for _, b in columns[:8]], [[c, *v[:8]] for c, v in values.items()])
    write("minkowski_w102.csv", "sample", [b for _, b in columns[8:]], [[c, *(x + 1e-4 for x in v[8:])] for c, v in values.items()])
    assert compare.main([str(tmp_path / "ours.csv"), str(tmp_path)]) == 0
    told = capsys.readouterr().out.splitlines()
    assert [x.split(":")[0] for x in told] == ["PASS skeleton", "SKIP mechanical", "SKIP soi", "SKIP orientation", "PASS minkowski"]
    assert told[0].endswith("8 columns x 24 specimens, 0 mismatches, 0 missing, max_abs=0, max_rel=0") and "max_abs=0.0001, max_rel=5.5" in told[4]
    write("skeleton.csv", "sample", [b for _, b in columns[:8]], [[c, *(x + (c == "QC007") for x in v[:8])] for c, v in values.items() if c != "QC009"])
    assert compare.main([str(tmp_path / "ours.csv"), str(tmp_path)]) == 1
    told = capsys.readouterr().out
    assert "FAIL skeleton: 8 columns x 23 specimens, 8 mismatches, 1 missing, max_abs=1, max_rel=0.125" in told and "QC007" in told and "QC009 missing in theirs" in told
    write("ours.csv", "filename", ["a"], [["QC001", 1], ["qc001.tif", 2]])
    with pytest.raises(compare.ParityError):
        compare.main([str(tmp_path / "ours.csv"), str(tmp_path)])


def test_curvature_at_points():
    g = np.arange(44) - 21.5
    ball = g[:, None, None] ** 2 + g[:, None] ** 2 + g**2 <= 12**2
    (r,) = fields.curvature_samples(ball, 1.0, [(33, 22, 22)], 1.5)
    phi = fields.smooth(fields.signed_distance(ball, 1.0), 1.5)
    mean, gauss = fields.curvature(phi, 1.0)
    assert (r["phi"], r["mean"], r["gauss"]) == (phi[22, 22, 33], mean[22, 22, 33], gauss[22, 22, 33]) and r["mean"] > 0
    for bad in ((44, 0, 0), (1, 22, 22), (-1, 3, 3)):
        with pytest.raises(MorphometryError):
            fields.curvature_samples(ball, 1.0, [bad], 1.5)


def test_eigenvalues_of_fits():
    rng = np.random.default_rng(0)
    p = rng.normal(size=(400, 3))
    fit = intercepts.anisotropy(p / np.linalg.norm(p, axis=1, keepdims=True) * [2.0, 3.0, 5.0])
    assert 1 - fit["d1"] / fit["d3"] == pytest.approx(fit["da"]) and [fit["d3"] ** -0.5, fit["d2"] ** -0.5, fit["d1"] ** -0.5] == pytest.approx([2, 3, 5], rel=1e-6)
