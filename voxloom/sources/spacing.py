"""Voxel spacing: tables by file name, calibration text, isotropy rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Micrometres of a unit; fixed values.
UNITS_UM = {"nm": 0.001, "um": 1.0, "micron": 1.0, "microns": 1.0, "micrometer": 1.0, "micrometre": 1.0, "\xb5m": 1.0, "\u03bcm": 1.0, "mm": 1000.0, "cm": 10000.0, "in": 25400.0, "inch": 25400.0}
#: Micrometres of a TIFF resolution unit; fixed values.
RESOLUTION_UNIT_UM = {2: 25400.0, 3: 10000.0}


class SpacingError(ValueError):
    pass


def base_name(path: Column) -> Column:
    """Trimmed file name without folders, in lower case."""
    return F.lower(F.element_at(F.split(F.trim(path), "[/\\\\]"), -1))


def specimen_code(name: Column) -> Column:
    """Code of a file: no extension, no mask suffix, upper case."""
    stem = F.regexp_replace(F.lower(F.element_at(F.split(F.trim(name), "/"), -1)), r"\.tiff?$", "")
    return F.upper(F.regexp_replace(stem, r"(_bone|_binary|_roi_mask|_roi|_mask)+$", ""))


def by_code(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Files with their specimen code; a code of several files is an error that names some of them."""
    coded = files.withColumn("code", specimen_code(F.col(path_col)))
    twice = coded.groupBy("code").agg(F.count("*").alias("n"), F.min(path_col).alias("one"), F.max(path_col).alias("other")).filter("n > 1").limit(5).collect()
    if twice:
        raise SpacingError("several files for one code: " + "; ".join(f"{r['code']}: {r['one']}, {r['other']}" for r in twice))
    return coded


def unit_scale(unit: Column) -> Column:
    """Micrometres of a unit's name; null where unknown."""
    u = F.lower(F.trim(unit))
    out = F.lit(None).cast("double")
    for name, um in UNITS_UM.items():
        out = F.when(u == name, um).otherwise(out)
    return out


def description_value(text: Column, key: str) -> Column:
    """Value of a ``key=value`` line of an image description; null without the line."""
    found = F.regexp_extract(text, rf"(?m)^\s*{key}\s*=\s*([^\r\n]*)", 1)
    return F.when(found != "", F.trim(found))


def isotropy(x: Column, y: Column, z: Column) -> Column:
    """Problem of a spacing triple, or null: x and y within 1 %, all three within one millionth."""
    top, low = F.greatest(x, y, z), F.least(x, y, z)
    return (
        F.when(x.isNull() | y.isNull() | z.isNull(), "missing")
        .when((low <= 0) | F.isnan(x) | F.isnan(y) | F.isnan(z), "not positive")
        .when(F.abs(x - y) / F.greatest(x, y) > 0.01, "xy differ")
        .when((top - low) / top > 1e-6, "not isotropic")
    )


def checked_table(rows: DataFrame) -> DataFrame:
    """Spacing table (filename, spacing_micrometers) by normalised name, with each name's problem
    as a column: repeated names, values that are missing or not positive."""
    named = rows.select(base_name(F.col("filename")).alias("name"), F.col("spacing_micrometers").try_cast("double").alias("h_um"))
    return named.groupBy("name").agg(F.count("*").alias("rows"), F.min("h_um").alias("h_um"), F.min(F.coalesce(F.col("h_um") > 0, F.lit(False)) & ~F.isnan("h_um")).alias("good")).select(
        "name", "h_um", F.when(F.col("rows") > 1, "repeated").when(~F.col("good"), "not positive").alias("problem")
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read and check a spacing CSV; extra columns are ignored, a byte order mark is accepted."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.toDF(*[c.lstrip("\ufeff").strip() for c in raw.columns])
    missing = {"filename", "spacing_micrometers"} - set(raw.columns)
    if missing:
        raise SpacingError(f"columns missing: {', '.join(sorted(missing))}")
    found = checked_table(raw)
    bad = found.filter("problem IS NOT NULL").limit(5).collect()
    if bad:
        raise SpacingError("; ".join(f"{r['name']}: {r['problem']}" for r in bad))
    if found.isEmpty():
        raise SpacingError("empty spacing table")
    return found.select("name", "h_um")


def attach(files: DataFrame, spacing: DataFrame, path_col: str = "path") -> DataFrame:
    """Files with their spacing; h_um is null where the table lacks the name."""
    return files.withColumn("name", base_name(F.col(path_col))).join(spacing, "name", "left")


def require_all(files: DataFrame) -> DataFrame:
    """Fail before any work if a file has no spacing."""
    bad = files.filter("h_um IS NULL").select("name").limit(5).collect()
    if bad:
        raise SpacingError("no spacing for " + ", ".join(r["name"] for r in bad))
    return files
