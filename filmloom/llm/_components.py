"""Connected components of an edge table by alternating large and small stars, with no part of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b (long). A table a, b again: b is the smallest node that links lead to from a, for all nodes but roots.

    Minima are aggregated before they are shuffled, and the join of a node's edges to its minimum starts from tables, so
    that AQE can split a node with very many edges.
    """
    cur, before = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        now = _digest(cur)
        if now == before or not now[0]:
            return cur
        before = now
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = materialise(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large", (low, cur))
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        cur = materialise(small.where("a <> b").distinct(), "small", (low, large))
