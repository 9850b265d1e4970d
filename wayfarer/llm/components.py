"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star-least")
    moved = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star-large")
    forget(least)
    return moved


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest of them. Edges run from larger to smaller."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "star-small")
    forget(least)
    return moved


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> u, root: the smallest node that u reaches; only nodes with an edge to a smaller component have a row.

    Groups are never gathered: each step aggregates minima and joins them back. The minima are stored first, so that the
    join reads no aggregation and Spark's skew join can split a node with very many edges. Steps are stored in the
    shared folder until the edges stay as they are; older steps are removed.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        sign = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if sign["n"] == 0 or sign == seen:
            return edges.select("u", F.col("v").alias("root"))
        seen = sign
        large = _large_star(edges)
        small = _small_star(large)
        forget(edges, large)
        edges = small
