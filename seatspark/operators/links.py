"""Connected components of an edge table, by alternating star operations.

A large star points every node's larger neighbours at the smallest node it
knows; a small star does the same with its smaller neighbours and itself.
Repeated in turn they end in stars around each component's smallest node,
after a number of steps that grows with the logarithm of the edges, not with
the length of a chain. Each step is two aggregates with map-side combining and
two joins, cut by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """``edges``: hi > lo. Every neighbour above u is tied to the smallest of u and its neighbours."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below u, and u itself, is tied to the smallest neighbour of u."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node of an edge with the smallest node that it is linked to.

    Edges are undirected; repeated ones, loops and nulls may occur (a node of
    loops only, and a null, have no row).
    """
    now = cut_lineage(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    seen = _print(now)
    while seen[0]:
        now = cut_lineage(_small_star(_large_star(now)))
        found = _print(now)
        if found == seen:
            break
        seen = found
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
