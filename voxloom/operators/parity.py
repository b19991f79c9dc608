"""Comparison of result tables by specimen code, and summaries of repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABS, REL = 1e-8, 1e-7
#: Tolerances of columns whose meshes come from another backend.
MESH_ABS, MESH_REL = 2e-4, 5e-4


def code(name: Column) -> Column:
    found = F.regexp_extract(F.upper(name), r"QC\d{3}", 0)
    return F.when(found != "", found)


def close(a: Column, b: Column, abs_: float = ABS, rel: float = REL) -> Column:
    """Within either tolerance; NaN equals NaN."""
    return (F.isnan(a) & F.isnan(b)) | F.coalesce(F.abs(a - b) <= F.greatest(F.lit(abs_), rel * F.greatest(F.abs(a), F.abs(b))), F.lit(False))


def compare(ours: DataFrame, theirs: DataFrame, columns: list[str], abs_: float = ABS, rel: float = REL, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each code of either side: pass, and the columns that differ. Codes that one side
    lacks fail. Where codes are used again, ``by`` names columns of both sides that tell the uses apart."""
    a = ours.select(*by, code(F.col("filename")).alias("code"), *[F.col(c).alias(f"a_{c}") for c in columns]).filter("code IS NOT NULL")
    b = theirs.select(*by, code(F.col("filename")).alias("code"), *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("there")).filter("code IS NOT NULL")
    joined = a.withColumn("here", F.lit(True)).join(b, [*by, "code"], "full")
    odd = F.array_compact(F.array(*[F.when(~close(F.col(f"a_{c}"), F.col(f"b_{c}"), abs_, rel), F.lit(c)) for c in columns]))
    both = F.col("here") & F.col("there")
    return joined.select(*by, "code", F.coalesce(both & (F.size(odd) == 0), F.lit(False)).alias("pass"), F.when(F.coalesce(both, F.lit(False)), odd).alias("differ"), F.when(F.col("here").isNull(), "ours").when(F.col("there").isNull(), "theirs").alias("missing"))


def differences(ours: DataFrame, theirs: DataFrame, columns: list[str], abs_: float = ABS, rel: float = REL, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each column over the codes of both sides: how many values were compared, how many differ by more
    than both tolerances, and the largest absolute and relative difference of finite values (relative to
    theirs). Codes of one side alone are those that ``compare`` names."""
    a = ours.select(*by, code(F.col("filename")).alias("code"), *[F.col(c).cast("double").alias(f"a_{c}") for c in columns]).filter("code IS NOT NULL")
    b = theirs.select(*by, code(F.col("filename")).alias("code"), *[F.col(c).cast("double").alias(f"b_{c}") for c in columns]).filter("code IS NOT NULL")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in columns])).alias("x")
    rows = a.join(b, [*by, "code"]).select(pairs).select("x.*")
    whole = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    off = F.when(whole(F.col("a")) & whole(F.col("b")), F.abs(F.col("a") - F.col("b")))
    return rows.groupBy("column").agg(
        F.count("*").alias("compared"), F.count_if(~close(F.col("a"), F.col("b"), abs_, rel)).alias("mismatches"), F.coalesce(F.max(off), F.lit(0.0)).alias("max_abs"), F.coalesce(F.max(off / F.greatest(F.abs(F.col("b")), F.lit(1e-30))), F.lit(0.0)).alias("max_rel")
    )


def families(ours: DataFrame, theirs: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """Report over families: a family whose columns are not all there is skipped."""
    out = None
    for name, wanted in columns.items():
        if name not in theirs or not all(c in ours.columns and c in theirs[name].columns for c in wanted):
            row = ours.sparkSession.createDataFrame([(name, None, None, None, None, "SKIP")], "family string, code string, pass boolean, differ array<string>, missing string, status string")
        else:
            tol = (MESH_ABS, MESH_REL) if name == "minkowski" else (ABS, REL)
            row = compare(ours, theirs[name], wanted, *tol).select(F.lit(name).alias("family"), "*", F.when(F.col("pass"), "PASS").otherwise("FAIL").alias("status"))
        out = row if out is None else out.unionByName(row)
    return out


def run_summary(runs: DataFrame, by: list[str], value: str, ok: str = "ok") -> DataFrame:
    """Runs, those that went well, and over these the mean, deviation (0 of one), coefficient of
    variation (null where the mean is 0) and range; PASS, PARTIAL or FAIL of each group."""
    good, v = F.count_if(F.col(ok)), F.when(F.col(ok) & ~F.isnan(F.col(value).cast("double")), F.col(value))
    mean, sd = F.avg(v), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0)))
    return runs.groupBy(*by).agg(
        F.count("*").alias("runs"), good.alias("ok"), mean.alias("mean"), sd.alias("sd"), F.when(mean != 0, F.abs(sd / mean)).alias("cv"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.when(good == F.count("*"), "PASS").when(good > 0, "PARTIAL").otherwise("FAIL").alias("status"),
    )


# How result headers of other tools begin, and the name they stand for. A pattern
# without an end matches any ending.
HEADERS = (
    (r"^BV/TV$", "BV/TV"),
    (r"^BV($| |\()", "BV"),
    (r"^TV($| |\()", "TV"),
    (r"^Tb\.Th Mean", "Tb.Th Mean"),
    (r"^Tb\.Th Std Dev", "Tb.Th Std Dev"),
    (r"^Tb\.Th Max", "Tb.Th Max"),
    (r"^Tb\.Sp Mean", "Tb.Sp Mean"),
    (r"^Tb\.Sp Std Dev", "Tb.Sp Std Dev"),
    (r"^Tb\.Sp Max", "Tb.Sp Max"),
    (r"^Connectivity$", "Connectivity"),
    (r"^(Conn\.D|(?i:connectivity density|conn\. density))", "Connectivity density"),
    (r"^(\u0394\(\u03c7\)|(?i:corr\. euler|corrected euler|delta euler))", "Euler change/correction"),
    (r"^(?i:euler ch)", "Euler characteristic"),
)


def header_name(header: Column) -> Column:
    """Name of a result header; null for one that stands for nothing here. The first fit counts."""
    out, h = F.lit(None).cast("string"), F.trim(header)
    for pattern, name in reversed(HEADERS):
        out = F.when(h.rlike(pattern), name).otherwise(out)
    return out


def radii_check(fits: DataFrame) -> DataFrame:
    """Anisotropy recomputed from the shortest and longest radius and from the smallest and largest
    eigenvalue, beside the fit's own."""
    again = 1.0 - (F.col("radius_a") / F.col("radius_c")) * (F.col("radius_a") / F.col("radius_c"))
    eigen = 1.0 - F.col("d1") / F.col("d3")
    known = (F.col("radius_c") > 0) & (F.col("d3") > 0)
    cols = {"da": F.col("da"), "da_from_radii": F.when(known, again), "da_from_eigenvalues": F.when(known, eigen), "difference": F.when(known, F.greatest(F.abs(F.col("da") - again), F.abs(F.col("da") - eigen)))}
    return fits.select("specimen", *(["rep"] if "rep" in fits.columns else []), *[c.alias(n) for n, c in cols.items()])
