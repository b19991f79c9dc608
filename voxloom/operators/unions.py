"""Components of graphs that are tables of edges, many graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.session import cut


def components(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, component) of every node with an edge (by, a, b): the smallest node that it reaches.

    Rounds of two steps, each of which keeps what is connected: larger neighbours move to the smallest node
    around a node, then a node's smaller neighbours do. Minima are combined before the shuffle. A round is
    written to the shared folder; rounds end when nothing moves, after a logarithm of the longest path
    or so. Loops and repeated edges count once.
    """
    now = cut(_clean(edges.select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    before = None
    while (state := _state(now, by)) != before:
        before = state
        both = now.unionByName(now.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*by, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        wide = _clean(both.join(least, [*by, "a"]).filter("b > a").select(*by, F.col("b").alias("a"), F.col("m").alias("b")))
        least = wide.groupBy(*by, "a").agg(F.min("b").alias("m"))
        near = wide.join(least, [*by, "a"]).select(*by, F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = cut(_clean(near), "edges")
    ends = now.select(*by, F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(*by, F.col("a").alias("node"), F.col("b").alias("component")).unionByName(ends)


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").distinct()


def _state(edges: DataFrame, by: list[str]) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64(*by, "a", "b").cast("decimal(38,0)"))).first())
