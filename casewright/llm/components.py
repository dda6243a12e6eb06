"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """node, component (its smallest node) for each node of an edge; edges: a, b of one orderable type, no nulls.

    Union-find as alternating stars: each round links a node's larger neighbours to the smallest around it, then
    all its neighbours but the smallest to that one, until nothing changes; the rounds grow with the logarithm of
    the longest path. Neighbourhoods are never gathered: a round takes the least neighbour of each node, an
    aggregate that is combined before the exchange, and joins it back, so a hot node is split like any skewed
    join key. Each round is written to the shared folder and read again, and the one before it is removed.
    """
    scratch = Scratch(edges.sparkSession, tag)
    pairs = scratch.put(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(pairs)
    while now[0]:
        # Large star: both directions; a node's larger neighbours go to the least of it and its neighbours.
        both = pairs.union(pairs.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        # Small star: a node's smaller neighbours, and itself, go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        old, pairs = pairs, scratch.put(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct())
        scratch.drop(old)
        before, now = now, state(pairs)
        if now == before:
            break
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())
