"""Connected components of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut, release, spread_join


def _star(rows: DataFrame, lows: DataFrame) -> DataFrame:
    """Neighbours (u, v) beside their node's smallest m; a node with a large share of all neighbours is dealt out."""
    return spread_join(rows, lows, ["u"], ["v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of edges (a, b): the smallest node of each node's component, but for these smallest nodes themselves.

    By alternating large and small stars; each round is a written table, so a lost
    executor costs a read. Rounds grow with the logarithm of a chain's length. It ends
    where every node with a smaller neighbour has no other one.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")), "lows")
        if not lows.agg(F.count_if(F.expr("m < u AND n > 1"))).first()[0]:
            release(lows)
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        # The same pair may come from several neighbours; the small stars make them distinct.
        large = cut(_star(both.where("v > u"), lows).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "large")
        release(lows, edges)
        lows = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "lows")
        joined = _star(large, lows)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lows.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small, "edges")
        release(lows, large)
