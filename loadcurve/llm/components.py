"""Connected components of an edge table by alternating large-star and small-star steps, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcurve.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Loops and null ends are left out. The number of steps grows with the logarithm of a component's size; each
    step is written down, so that lost executors cost one step at most.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct())
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        # large star: greater neighbours of a node go to the least of all its neighbours and itself
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
