"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import store


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is the smallest node reachable.

    Each round points every neighbour at the smallest one, first towards
    larger nodes, then towards smaller ones, until nothing changes: a number
    of rounds that grows with the logarithm of the graph. Minima are combined
    before they are shuffled and a hub's edges are a splittable join side, so
    no task holds a hub."""
    edges = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    known = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_b")).select("a", F.least("a", "_b").alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(lower, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = store(small.unionByName(lower.select("a", F.col("least").alias("b"))).distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == known:
            break
        known = state
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
