"""Connected components of a distributed edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch


def _large_star(e: DataFrame, scratch: Scratch) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, scratch: Scratch) -> DataFrame:
    least = scratch.keep(e.groupBy("u").agg(F.min("v").alias("m")))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest reachable node.

    edges: two long columns u and v in any direction; loops and repeats are ignored, no edges give no rows.
    Rounds end when every node points at one root and no root points on; their number grows with the
    logarithm of the longest path. Minima are combined before the shuffle, so a node with very many edges
    costs one row a task there. They are written before they are joined with the edges, so that no aggregate stands
    between the exchange and the join and Spark's skew join can split the edges of such a node.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.keep(e)
    while True:
        after = scratch.keep(_small_star(scratch.keep(_large_star(e, scratch)), scratch))
        scratch.drop(e)
        e = after
        n, one = e.agg(F.count("*"), F.countDistinct("u")).first()
        if n == one and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def merged(comps: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """components of the edges that made comps and of further ones."""
    stars = comps.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    return components(stars.union(edges), scratch)
