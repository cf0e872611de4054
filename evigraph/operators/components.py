"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum joined back on the node, so no list of
neighbours is ever gathered, and hot nodes are left to the engine's splitting of
skewed joins. After each round the edges are written to the shared folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low"))
    joined = both.join(least, F.col("a") == F.col("node"))
    if large:  # larger neighbours move to the least one
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:  # smaller neighbours, and the node itself, move to the least one
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("low").alias("b")))
    return moved.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the edges (a, b): the least node that it reaches."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    seen, scratch = None, Scratch()
    for _ in range(rounds):
        edges = scratch.written(_star(_star(edges, True), False), "components")
        scratch.clear(keep=1)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
