"""Connected components of an edge table by alternating large and small stars.

Each pass points the nodes of a star at its smallest node (Kiveris et al., 2014); passes are
logarithmic in practice. Minima are aggregated before the shuffle; the edges of a node meet its
minimum in one task, or, where a node has very many of them, in several, dealt by their other end, so no
single task holds them and other nodes are not repeated. Each pass is written to the shared folder; there is none where the edges are stars already, and none
to see that they no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.base import materialize


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: each u has one edge and is no other's v. One aggregation."""
    role = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"))
    nodes = edges.select(F.explode(F.array(role("u", 1), role("v", 0))).alias("x")).select("x.*")
    seen = nodes.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return seen.filter((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("low") == 0))).isEmpty()


#: Tasks that the edges of a node are dealt to that has more than MANY.
SALTS, MANY = 8, 256


def _beside(rows: DataFrame, low: DataFrame) -> DataFrame:
    """Rows (u, v) with the minimum m of u; ``low`` has u, m and n, the number of u's rows. Nodes with many rows are few
    beside the rows, at most one in MANY, so only they are told to the rows and repeated."""
    many = low.filter(F.col("n") > MANY).select("u", F.lit(SALTS).alias("salts"))
    dealt = rows.join(F.broadcast(many), "u", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.lit(SALTS))).cast("int")).drop("salts")
    return dealt.join(_repeated(low), ["u", "salt"]).drop("salt")


def _repeated(low: DataFrame) -> DataFrame:
    """(u, m, salt): a row for each node, for each salt of those with many rows."""
    one, several = low.filter(F.col("n") <= MANY).select("u", "m", F.lit(0).alias("salt")), low.filter(F.col("n") > MANY)
    return one.unionByName(several.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes with an edge and their component's smallest node: (node, component).

    Loops, repeated edges and edges with a null end are ignored; an empty table gives no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    e = materialize(e, "edges")
    while not _settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        # large star: neighbours above u point at the smallest of u's neighbourhood
        large = _beside(both, low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # small star: u and its neighbours below point at the smallest of them
        small = _beside(large, low).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        e = materialize(small, "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
