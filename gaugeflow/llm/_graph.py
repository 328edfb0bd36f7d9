"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm._scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u")
    return linked.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m")).distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b: long) that isn't its component's smallest; root is that smallest node.

    Every round is two aggregations and two joins of written tables; a node with very many edges is summed before the
    shuffle, and its edges are split over tasks by adaptive skew joins. Rounds grow with the logarithm of the longest path.
    """
    now = scratch.table(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    state = None
    while True:
        wide = scratch.table(_large_star(now))
        after = scratch.table(_small_star(wide))
        scratch.drop(now, wide)
        now = after
        row = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(row) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(row)
