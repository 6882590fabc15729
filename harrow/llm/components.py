"""Connected components of a graph whose edges are rows, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node with their smallest: those above the node (large), or those below.

    ``edges`` has rows (u, v), u > v. Smallest neighbours are partial aggregates; the join behind them
    is one that Spark can split where a node has very many neighbours.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        return both.join(least, "u").filter("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that each node with a link can reach, the root included.

    Each round is written to the shared folder, so the plan stays short and survives lost executors.
    The number of rounds grows with the logarithm of the longest path.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges = written(edges)
    while not _is_star_forest(edges):
        step = _stars(edges, large=True).distinct()
        step = written(_stars(step, large=False).distinct())
        drop_written(edges)
        edges = step
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _is_star_forest(edges: DataFrame) -> bool:
    """Has every node one smaller neighbour at most, which itself has none?"""
    if not edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return False
    centres = edges.select(F.col("v").alias("u")).distinct()
    return edges.join(centres, "u", "left_semi").isEmpty()
