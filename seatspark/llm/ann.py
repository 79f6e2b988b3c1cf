"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each quantised by its own centroids; a cell is a
pair of centroids. A query visits cells in order of the summed distance of its
halves to the pair, taken from a heap, until the cells hold enough vectors;
those are reranked by exact distance. Then it visits every other cell that may
hold a vector at most as far as the last one found, so the result is exact.
Small cells share a block and large ones are cut into several; blocks are what
is dealt out.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import ready, saved

BLOCK_ROWS = 4096  # vectors that one group holds
BLOCK_QUERIES = 4096  # queries that one group holds


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, rows of x by rows of y."""
    return (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :]


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of the rows of x (fewer than k if there are fewer different rows)."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest_cells(q: np.ndarray, halves: tuple[np.ndarray, np.ndarray], counts: dict[int, int], enough: int) -> list[int]:
    """Cells in order of summed distance until they hold ``enough`` vectors.

    The heap holds pairs of ranks in the two sorted centroid lists; a pair is
    followed by its two neighbours, so cells come out in exact order.
    """
    cut = len(q) // 2
    d1, d2 = (_distances(part[None], c)[0] for part, c in zip((q[:cut], q[cut:]), halves))
    o1, o2 = d1.argsort(kind="stable").tolist(), d2.argsort(kind="stable").tolist()
    d1, d2 = d1.tolist(), d2.tolist()
    heap, pushed, out, held, left = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, [], 0, len(counts)
    while heap and held < enough and left:
        _, i, j = heapq.heappop(heap)
        cell = o1[i] * len(o2) + o2[j]
        if n := counts.get(cell):
            out.append(cell)
            held += n
            left -= 1
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < len(o2) and (a, b) not in pushed:
                pushed.add((a, b))
                heapq.heappush(heap, (d1[o1[a]] + d2[o2[b]], a, b))
    return out


def cells_within(q: np.ndarray, halves: tuple[np.ndarray, np.ndarray], cells: np.ndarray, near: np.ndarray,
                 far: np.ndarray, bound: float) -> np.ndarray:
    """Cells that may hold a vector at distance ``bound`` or less.

    ``near``, ``far`` (cells, 2): smallest and largest distance of the cells'
    halves to their centroids. By the triangle inequality a half of the query at
    distance d from the centroid is no nearer than d - far and near - d.
    """
    cut, least = len(q) // 2, np.zeros(len(cells))
    for i, (part, c, at) in enumerate(zip((q[:cut], q[cut:]), halves, np.divmod(cells, len(halves[1])))):
        d = np.sqrt(((c - part) ** 2).sum(1))[at]
        slack = 1e-12 * (d + far[:, i])  # of rounding
        least += np.maximum(np.maximum(d - far[:, i], near[:, i] - d) - slack, 0) ** 2
    return cells[~(np.sqrt(least) > bound * (1 + 1e-12))]


def blocks_of(counts: dict[int, int], rows: int = BLOCK_ROWS) -> dict[int, tuple[int, int]]:
    """First block and number of blocks of each cell: blocks of about ``rows`` vectors at most."""
    out, block, held = {}, 0, 0
    for cell, n in sorted(counts.items()):
        if held and held + n > rows:
            block, held = block + 1, 0
        out[cell] = block, -(-n // rows)
        held += n
        if held >= rows:
            block, held = block + out[cell][1], 0
    return out


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part, in double precision.

    Not: null ids, null or empty vectors, null or non-finite components, all
    zeros, and vectors of another length than the most frequent one.
    """
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("vector")).where(
        "vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < "
        "double('infinity')) and exists(vector, x -> x != 0)")
    top = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (top["d"] if top else 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, enough: int = 6000, centroids: int = 64,
           sample: int = 16384, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the nearest vectors for each row of ``queries``.

    ``queries`` and ``vectors``: vec_id and a vector; a query's own vec_id is no
    candidate. Nearness is Euclidean distance in double precision, ties to the
    smaller vec_id. Rows that `usable` leaves out take no part. The centroids
    (``centroids`` a half) are fitted on the ``sample`` vectors of smallest hash,
    and every vector is indexed. A query's first cells hold at least ``enough``
    vectors (all, if there are fewer); the k-th distance found there bounds the
    second visit, so ``enough`` and the centroids affect speed only. Vectors and
    queries are dealt out in groups of bounded size. Repeated rows of one vec_id
    count once.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = saved(usable(ready(vectors), vector).dropDuplicates(["vec_id"]), "vectors")
    picked = np.array([r["vector"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()])
    if not len(picked):
        return spark.createDataFrame([], schema)
    cut = picked.shape[1] // 2
    halves = (k_means(picked[:, :cut], centroids), k_means(picked[:, cut:], centroids))
    shared = spark.sparkContext.broadcast(halves)

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy().reshape(len(column), -1)

    def assign(batches):
        c1, c2 = shared.value
        for b in batches:
            x = matrix(b.column(1)) if b.num_rows else np.zeros((0, c1.shape[1] + c2.shape[1]))
            a1, a2 = _distances(x[:, :cut], c1).argmin(1), _distances(x[:, cut:], c2).argmin(1)
            d1, d2 = (np.sqrt(((p - c) ** 2).sum(1)) for p, c in ((x[:, :cut], c1[a1]), (x[:, cut:], c2[a2])))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(a1 * len(c2) + a2, pa.int64()), pa.array(d1), pa.array(d2)],
                ["vec_id", "vector", "cell", "d1", "d2"])

    placed = saved(rows.mapInArrow(assign, "vec_id long, vector array<double>, cell long, d1 double, d2 double"), "cells")
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *(
        f(d) for d in ("d1", "d2") for f in (F.min, F.max))).orderBy("cell").collect()  # centroids ** 2 at most
    counts = {r["cell"]: r["n"] for r in stats}
    near, far = (np.array([[r[k], r[k + 2]] for r in stats]) for k in (2, 3))
    near[~np.isfinite(near)] = 0
    cells = spark.sparkContext.broadcast((counts, blocks_of(counts), np.array(list(counts)), near, far))

    def block(batches):
        blocks = cells.value[1]
        for b in batches:
            first, parts = np.array([blocks[c] for c in b.column(2).to_pylist()], np.int64).reshape(-1, 2).T
            at = first + b.column(3).to_numpy() % parts
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int64())],
                                             ["vec_id", "vector", "block"])

    dealt_rows = placed.select("vec_id", "vector", "cell", F.xxhash64("vec_id")).mapInArrow(
        block, "vec_id long, vector array<double>, block long")

    def blocks_at(found) -> set[int]:
        return {b for first, parts in (cells.value[1][c] for c in found) for b in range(first, first + parts)}

    def first_visit(batches):
        for b in batches:
            to = [sorted(blocks_at(nearest_cells(q, shared.value, cells.value[0], enough + 1)))
                  for q in (matrix(b.column(1)) if b.num_rows else ())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to, pa.list_(pa.int64()))],
                                             ["vec_id", "vector", "blocks"])

    def second_visit(batches):
        for b in batches:
            to = [sorted(blocks_at(cells_within(q, shared.value, *cells.value[2:], bound).tolist()) - set(done))
                  for q, done, bound in zip(matrix(b.column(1)) if b.num_rows else (), b.column(2).to_pylist(),
                                            b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to, pa.list_(pa.int64()))],
                                             ["vec_id", "vector", "blocks"])

    def rerank(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.sort_by("vec_id").combine_chunks()
            q, x = (matrix(t.column("vector").combine_chunks()) for t in (left, right))
            q_ids, x_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            for i in range(len(q)):
                d = np.sqrt(((x - q[i]) ** 2).sum(1))
                d[x_ids == q_ids[i]] = np.inf
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                near = near[np.argsort(d[near], kind="stable")][:k]  # ids ascend, so ties go to the smaller
                near = near[np.isfinite(d[near])]
                for part, values in zip(out, ([q_ids[i]] * len(near), x_ids[near], d[near])):
                    part.extend(values)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def nearest(probes: DataFrame) -> DataFrame:
        """query_id, vec_id, score of the k nearest vectors in the blocks of each row."""
        probes = probes.select("vec_id", "vector", F.explode("blocks").alias("block"))
        parts = saved(probes.groupBy("block").agg(
            F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("parts")), "block-parts")
        left = probes.join(parts, "block").select(
            "vec_id", "vector", "block", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"))
        right = dealt_rows.join(parts, "block").select(
            "vec_id", "vector", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(
            rerank, "query_id long, vec_id long, score double")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")

    visits = "vec_id long, vector array<double>, blocks array<long>"
    asked = usable(queries, vector).where(F.size("vector") == picked.shape[1]).dropDuplicates(["vec_id"])
    probes = saved(asked.mapInArrow(first_visit, visits), "probes")
    first = saved(nearest(probes), "found")
    bounds = first.groupBy(F.col("query_id").alias("vec_id")).agg(
        F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("bound"))
    left = probes.join(bounds, "vec_id", "left").select(
        "vec_id", "vector", "blocks", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    rest = nearest(saved(left.mapInArrow(second_visit, visits), "probes-left"))
    return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
