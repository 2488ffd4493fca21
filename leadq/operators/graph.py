"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadq.operators.skew import HEAVY_ROWS, join_groups
from leadq.session import cut


def connected_components(edges: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """`edges(a, b)` with a < b  ->  `(node, component)`, component = smallest node reached.

    Alternates the large-star and small-star steps, which turn every component into a star
    around its smallest node in a number of rounds that grows with the logarithm of its size.
    The neighbours of a node are only ever reduced to aggregates; no neighbour list is built.
    Rounds go on until an exact test finds stars only. Each round is cut by a checkpoint.
    """
    current = cut(edges.select("a", "b").distinct())
    while True:
        both = current.union(current.select("b", "a"))
        stats = cut(
            both.groupBy(F.col("a").alias("node")).agg(
                F.min("b").alias("lowest"),
                F.count_if(F.col("b") < F.col("a")).alias("below"),
                F.count_if(F.col("b") > F.col("a")).alias("above"),
            )
        )
        # A star centre has no lower neighbour and a leaf has exactly one neighbour.
        open_nodes = stats.filter((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0)))
        if open_nodes.isEmpty():
            break
        # large star: every neighbour above a node moves to the node's smallest neighbour
        lows = stats.filter("above > 0").select(
            F.col("node").alias("a"), F.least("node", "lowest").alias("low"), F.col("above").alias("size")
        )
        raised = cut(
            join_groups(current, lows, "a", "size", heavy_rows, ready=True)
            .select(F.col("b").alias("child"), F.col("low").alias("parent"))
            .distinct()
        )
        # small star: a node and its parents move to the smallest of its parents
        tops = cut(raised.groupBy("child").agg(F.min("parent").alias("top"), F.count("*").alias("size")))
        moved = (
            join_groups(raised, tops.filter("size > 1"), "child", "size", heavy_rows, ready=True)
            .filter(F.col("parent") != F.col("top"))
            .select(F.col("top").alias("a"), F.col("parent").alias("b"))
        )
        current = cut(tops.select(F.col("top").alias("a"), F.col("child").alias("b")).union(moved).distinct())
    leaves = current.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return leaves.union(current.select("a", "a").distinct())
