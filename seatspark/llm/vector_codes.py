"""Vector codes: product quantisation in exact integers, by limb-split matrix products.

Components become ``floor(scale * x)``; a vector is cut into equal parts, and
each part is replaced by the index of its nearest codebook entry. Distances
are ``|x|^2 - 2 x.c + |c|^2`` in 64-bit integers. Their dot products come from
float64 BLAS: integers are split into limbs so short that no product of limbs,
summed over a part, passes 2**53; each is therefore exact, and the products of
limbs are shifted and added in int64. ``argmin`` takes the first minimum, so
ties go to the lower index. Nothing depends on the order or the layout of rows.

Spark holds the integer vectors as a table; a round is one pass over it. Tasks
send sums and counts of their own rows, a row for each codebook component, so
the driver gets codebook-sized tables only, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ready, saved


def limb_bits(length: int) -> int:
    """Bits of a limb so that ``length`` products of two limbs sum to 2**53 at most."""
    return (53 - max(length - 1, 0).bit_length()) // 2


def _limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 matrices, lowest limb first; the last one carries the sign."""
    out, peak = [], int(np.abs(values).max(initial=0))
    while peak >> bits:
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values, peak = values >> bits, (peak >> bits) + 1
    return out + [values.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exact where the result fits 64 bits."""
    bits = limb_bits(a.shape[1])
    total = np.zeros((len(a), len(b)), np.int64)
    right = _limbs(b, bits)
    for i, x in enumerate(_limbs(a, bits)):
        for j, y in enumerate(right):
            if bits * (i + j) < 64:
                total += (x @ y.T).astype(np.int64) << np.int64(bits * (i + j))
    return total


def part_bounds(length: int, parts: int) -> list[int]:
    """Bounds of the consecutive parts; sizes differ by one at most where ``parts`` does not divide ``length``."""
    return [length * k // parts for k in range(parts + 1)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (first of equals) and the squared distance, for each row of int64 ``x``."""
    distances = (book * book).sum(1)[None, :] - 2 * exact_products(x, book)
    which = distances.argmin(1)
    return which, distances[np.arange(len(x)), which] + (x * x).sum(1)


class Codebooks(NamedTuple):
    """``books[p]`` holds the int64 entries of part ``p``; ``scale`` made the integers."""

    books: list[np.ndarray]
    scale: int

    def sha256(self) -> str:
        """Digest of all entries' decimal components by part, entry and position."""
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for."""
        return [v / self.scale for p, b in enumerate(self.books) for v in b[int(code[2 * p:2 * p + 2], 16)].tolist()]


def integer_vectors(rows: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """vec_id, label and ``v`` (array of long) of the rows whose vector is whole and finite."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & ~bad).select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"),
        F.transform(v, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


def _round(ints: DataFrame, books: list[np.ndarray], bounds: list[int]) -> list[np.ndarray]:
    """The codebooks after one round: floored means of the parts assigned to each entry."""
    def sums(batches):
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            x = _matrix(batch.column(0)) if batch.num_rows else None
            for p, (low, high) in enumerate(zip(bounds, bounds[1:])):
                if x is not None:
                    part = x[:, low:high]
                    chosen = (nearest(part, books[p])[0] == np.arange(len(books[p]))[:, None]).astype(np.int64)
                    counts[p] += chosen.sum(1)
                    totals[p] += exact_products(chosen, np.ascontiguousarray(part.T))
        for p, total in enumerate(totals):
            used = np.flatnonzero(counts[p])
            width = total.shape[1]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([p] * len(used) * width, pa.int32()),
                "entry": pa.array(np.repeat(used, width).astype(np.int32)),
                "place": pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))),
                "n": np.repeat(counts[p][used], width), "total": total[used].ravel()})

    made = [b.copy() for b in books]
    rows = ready(ints).select("v").mapInArrow(sums, "part int, entry int, place int, n long, total long")
    for r in rows.groupBy("part", "entry", "place").agg(
            F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        made[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return made


def fit(ints: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> Codebooks | None:
    """Codebooks from the ``entries`` smallest vec_ids, after ``rounds`` rounds; None without rows.

    A round that changes nothing ends the loop, as the rest would change nothing.
    """
    first = [r["v"] for r in ints.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    if not first:
        return None
    start, bounds = np.array(first, np.int64), part_bounds(len(first[0]), parts)
    books = [np.ascontiguousarray(start[:, a:b]) for a, b in zip(bounds, bounds[1:])]
    for _ in range(rounds):
        made = _round(ints, books, bounds)
        if all(np.array_equal(a, b) for a, b in zip(made, books)):
            break
        books = made
    return Codebooks(books, scale)


def encode(ints: DataFrame, found: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distance over all parts)."""
    bounds = np.cumsum([0] + [b.shape[1] for b in found.books]).tolist()
    digits = np.array([f"{k:02x}" for k in range(256)])

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            code, error = np.full(len(x), "", "U1"), np.zeros(len(x), np.int64)
            for book, low, high in zip(found.books, bounds, bounds[1:]):
                which, distance = nearest(x[:, low:high], book)
                code, error = np.char.add(code, digits[which]), error + distance
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(code.tolist(), pa.string()), pa.array(error)],
                ["vec_id", "label", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in ints.schema.fields}
    return ready(ints).mapInArrow(
        assign, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """Codes of all vectors: vec_id, code, error, label_error (sum over the label), codebooks_sha256.

    Rows whose vector is null, empty or holds null or non-finite components
    take no part, nor do vectors of another length than that of the first
    (smallest vec_id, null last). Fewer rows than ``entries`` give as many
    entries. Repeated vec_ids are rows of their own, ordered by their vectors;
    a null label is a label. Other columns are not looked at. An empty table
    gives no rows. Components so large that a distance might pass 64 bits
    raise ValueError before the first round.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    ints = saved(integer_vectors(rows, vec_id, vector, label, scale), "vectors")
    first = ints.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    if first:
        ints = ints.where(F.size("v") == first["n"])
        peak = ints.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0]
        if first["n"] * (2 * peak + 2) ** 2 >= 1 << 63:
            raise ValueError(f"components of {peak} / {scale} are too large for 64-bit distances")
    found = fit(ints, parts, entries, rounds, scale)
    digest = found.sha256() if found else None
    if found is None:
        coded = ints.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = saved(encode(ints, found), "codes")
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))
