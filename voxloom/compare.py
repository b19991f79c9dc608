"""Command line: ``python -m voxloom.compare OURS.csv FOLDER`` holds a result table against reference tables.

The folder has one CSV for each descriptor family, with specimens by ``sample``. Families whose columns
our table lacks are skipped; the exit code is 1 if any value differs by more than both tolerances.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import parity
from voxloom.operators.report import FAMILY_COLUMNS
from voxloom.session import session

# Table of each family, the columns it is held against, and the one column whose
# name there is not what follows the dot in ours.
TABLES = {"skeleton": "skeleton", "mechanical": "mechanical_graph", "soi": "soi_proxy", "orientation": "orientation_field", "minkowski": "minkowski_w102"}
COMPARED = {"soi": 6, "minkowski": 2}
RENAMED = {"skeleton.length_density_mm_per_mm3": "skeleton_length_density_mm_per_mm3"}
MOST_SHOWN = 12


class ParityError(ValueError):
    pass


def pairs(family: str) -> list[tuple[str, str]]:
    """(our column, their column) of a family."""
    ours = [name for _, name in FAMILY_COLUMNS[family]][: COMPARED.get(family)]
    return [(c, RENAMED.get(c, c.partition(".")[2])) for c in ours]


def _keyed(df: DataFrame, key: str, columns: list[tuple[str, str]], what: str) -> DataFrame:
    """Rows with the code's source as ``filename`` and the columns under plain names; each code once."""
    out = df.select(F.col(f"`{key}`").alias("filename"), *[F.col(f"`{c}`").cast("double").alias(n) for c, n in columns])
    coded = out.withColumn("code", parity.code(F.col("filename")))
    bad = coded.groupBy("code").count().filter("code IS NULL OR count > 1").limit(3).collect()
    if bad:
        raise ParityError(f"{what}: " + "; ".join("a row without a code" if r["code"] is None else f"{r['code']} {r['count']} times" for r in bad))
    return out


def report(spark: SparkSession, ours_csv: str, folder: str, specimens: int = 24, tolerances: tuple[float, float] = (parity.ABS, parity.REL), mesh: tuple[float, float] = (parity.MESH_ABS, parity.MESH_REL)) -> list[tuple[str, str, list, dict]]:
    """(family, PASS, FAIL or SKIP, first differences as (code, columns), sums) of each family. The sums are the
    number of specimens and columns compared, of values that differ and of specimens that one side lacks, and the
    largest absolute and relative difference. Our codes must
    be QC001 to the number of specimens, each once; 0 allows any."""
    ours = spark.read.csv(ours_csv, header=True)
    codes = {r["code"] for r in _keyed(ours, "filename", [], ours_csv).select(parity.code(F.col("filename")).alias("code")).collect()}
    if specimens and codes != {f"QC{k:03d}" for k in range(1, specimens + 1)}:
        raise ParityError(f"codes must be QC001 to QC{specimens:03d}")
    out = []
    for family, table in TABLES.items():
        columns = pairs(family)
        if not all(a in ours.columns for a, _ in columns):
            out.append((family, "SKIP", [], {}))
            continue
        theirs = spark.read.csv(f"{folder.rstrip('/')}/{table}.csv", header=True)
        a = _keyed(ours, "filename", [(x, f"c{k}") for k, (x, _) in enumerate(columns)], ours_csv)
        b = _keyed(theirs, "sample", [(y, f"c{k}") for k, (_, y) in enumerate(columns)], table)
        plain, tol = [f"c{k}" for k in range(len(columns))], mesh if family == "minkowski" else tolerances
        rows = parity.compare(a, b, plain, *tol)
        odd = rows.filter(~F.col("pass") & (F.coalesce("missing", F.lit("")) != "ours")).orderBy("code").limit(MOST_SHOWN).collect()
        sums = parity.differences(a, b, plain, *tol).agg(F.max("compared").alias("specimens"), F.count("*").alias("columns"), F.sum("mismatches").alias("mismatches"), F.max("max_abs").alias("max_abs"), F.max("max_rel").alias("max_rel")).first().asDict()
        sums = {k: v or 0 for k, v in sums.items()} | {"missing": rows.filter("missing = 'theirs'").count()}
        out.append((family, "FAIL" if odd else "PASS", [(r["code"], [columns[int(c[1:])][0] for c in r["differ"] or []] or f"missing in {r['missing']}") for r in odd], sums))
    if all(status == "SKIP" for _, status, _, _ in out):
        raise ParityError("no family can be compared")
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="voxloom.compare")
    p.add_argument("ours")
    p.add_argument("folder")
    p.add_argument("--specimens", type=int, default=24)
    p.add_argument("--atol", type=float, default=parity.ABS)
    p.add_argument("--rtol", type=float, default=parity.REL)
    p.add_argument("--w102-atol", type=float, default=parity.MESH_ABS)
    p.add_argument("--w102-rtol", type=float, default=parity.MESH_REL)
    o = p.parse_args(argv)
    found = report(session(), o.ours, o.folder, o.specimens, (o.atol, o.rtol), (o.w102_atol, o.w102_rtol))
    for family, status, odd, n in found:
        told = f": {n['columns']} columns x {n['specimens']} specimens, {n['mismatches']} mismatches, {n['missing']} missing, max_abs={n['max_abs']:.6g}, max_rel={n['max_rel']:.6g}" if n else ""
        print(f"{status} {family}{told}")
        for code, what in odd:
            print("  ", code, what)
    return int(any(status == "FAIL" for _, status, _, _ in found))


if __name__ == "__main__":
    sys.exit(main())
