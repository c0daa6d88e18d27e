"""Distributed union-find: connected components by alternating stars.

Large-star and small-star steps (Kiveris et al. 2014) link every node to the
least node near it until each component is a star round its least node. A step
is partial minima and joins on node ids; hot nodes are split by adaptive skew
joins, rows are pairs of longs, and each round is written to the shared folder,
so the plan stays short and a lost executor costs one round at most. The
number of rounds grows with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._run import written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _are_stars(e: DataFrame) -> bool:
    """No node is a leaf twice, or both a leaf and a centre."""
    nodes = e.select("a").unionByName(e.select(F.col("b").alias("a")).distinct())
    return nodes.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: longs), where root is its component's least node.

    Loops and repeated edges do no harm; a node whose only edges are loops is
    not returned. No edges: no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = written(e)
    while not _are_stars(e):
        e = written(_small_star(_large_star(e)))
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
