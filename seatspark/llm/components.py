"""Connected components of an edge table, by contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ready, saved


def _local_stars(batches):
    """Edges of one task as stars around the smallest node of each local component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if parent[x] != x]
    for k in range(0, len(nodes), 20000):
        part = nodes[k:k + 20000]
        yield pa.RecordBatch.from_pydict({"a": pa.array([root(x) for x in part], pa.int64()),
                                          "b": pa.array(part, pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b: long); the component is its smallest node.

    Each round lets every node point to its smallest neighbour, follows the
    pointers twice, and replaces the nodes of the remaining edges by what they
    point to. At least half of the nodes that have edges go in each round, so
    the number of rounds is logarithmic. Null ends are ignored; an empty table
    gives no rows.
    """
    rest = saved(ready(edges).where("a is not null and b is not null and a != b").select("a", "b")
                 .mapInArrow(_local_stars, "a long, b long").distinct(), "edges")
    labels = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
            "node", F.least("node", "m").alias("up"))
        up = saved(up, "pointers")
        for _ in range(2):
            up = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select(
                "node", F.col("top").alias("up"))
        up = saved(up, "pointers")
        if labels is None:
            labels = up.select("node", F.col("up").alias("component"))
        else:
            labels = saved(labels.join(up.select(F.col("node").alias("component"), "up"), "component", "left").select(
                "node", F.coalesce("up", "component").alias("component")), "labels")
        for end in ("a", "b"):
            rest = rest.join(up.select(F.col("node").alias(end), "up"), end).drop(end).withColumnRenamed("up", end)
        rest = saved(rest.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                     .distinct(), "edges")
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    return labels
