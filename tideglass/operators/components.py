"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _settled(pairs: DataFrame) -> bool:
    """Whether ``pairs`` are stars: every upper node has one pair and is the lower one of none."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(pairs.select("v", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n")).where("up > 0 AND n > 1").isEmpty()


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, label for every node of ``edges`` (u long, v long); label: the component's least node.

    Alternating large-star and small-star steps ("Connected Components in MapReduce and Beyond",
    Kiveris et al., 2014): each ties a node's neighbours to the least of them, never adds a pair
    and settles in O(log^2 n) rounds at most, so there is no cap on rounds. ``keep`` writes a
    table and reads it back, which cuts the lineage. An edge table without rows gives no rows.
    """
    edges = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    pairs = edges.where("u <> v")
    while not _settled(pairs):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root"))
        pairs = keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("root").alias("v")).distinct())
        least = pairs.groupBy("u").agg(F.min("v").alias("root"))
        tied = pairs.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("root").alias("v"))
        pairs = keep(tied.where("u <> v").distinct())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return keep(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label")))
