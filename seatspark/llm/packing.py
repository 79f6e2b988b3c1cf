"""Best-fit packing of documents into sequences, by bin completion.

The search runs on the histogram of piece lengths (at most ``capacity`` rows,
however many documents), so it is the same work at every size. Each step takes
the largest length left, enumerates the undominated fillings of the room beside
it, and applies the chosen filling as often as the histogram allows. Fillings
are tried by least waste; a branch ends once its waste exceeds what the best
known solution leaves (waste bound). Best-fit decreasing gives the first
solution, and each better one found replaces it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import frugal, ready, saved
from .textops import text_slices
from .tokens import encoder_for

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first
Plan = list[tuple[Filling, int]]  # a filling and in how many sequences it is used


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing: beside the largest length, always the largest that still fits."""
    left, plan = Counter(counts), []
    sizes = sorted((s for s in left if left[s] > 0), reverse=True)
    while sizes:
        room, used = capacity, Counter()
        for s in sizes:
            if n := min(room // s, left[s]):
                used[s] = n
                room -= n * s
        plan.append(_apply(left, used))
        sizes = [s for s in sizes if left[s]]
    return plan


def _apply(left: Counter, used: Counter) -> tuple[Filling, int]:
    """Use a filling as often as the lengths last."""
    times = min(left[s] // n for s, n in used.items())
    for s, n in used.items():
        left[s] -= n * times
    return tuple(sorted(used.items(), reverse=True)), times


def completions(left: dict[int, int], room: int, limit: int, tries: int) -> list[tuple[int, Filling]]:
    """Undominated fillings of ``room``: (waste, filling), least waste first.

    A filling is dominated if another uses fewer, longer pieces for the same
    waste or if a piece left over still fits; exact two-piece fits end the
    search, as nothing dominates them. ``tries`` bounds the nodes looked at.
    """
    sizes = sorted((s for s, n in left.items() if n > 0 and s <= room), reverse=True)
    if not sizes:
        return [(room, ())]
    if left.get(room, 0) > 0:
        return [(0, ((room, 1),))]
    found: dict[int, Filling] = {}
    smallest, nodes = sizes[-1], 0
    stack: list[tuple[int, int, Filling]] = [(0, room, ())]
    while stack and nodes < tries:
        k, rest, used = stack.pop()
        nodes += 1
        if rest < smallest or k == len(sizes):
            if not any(left[s] > dict(used).get(s, 0) for s in sizes if s <= rest):
                best = found.get(rest)
                if best is None or sum(n for _, n in used) < sum(n for _, n in best):
                    found[rest] = used
                if rest == 0 and len(found) >= limit:
                    break
            continue
        while k < len(sizes) and sizes[k] > rest:
            k += 1
        if k == len(sizes):
            stack.append((k, rest, used))
            continue
        s = sizes[k]
        for n in range(0, min(rest // s, left[s]) + 1):  # the most of the longest is tried first
            stack.append((k + 1, rest - n * s, used + ((s, n),) if n else used))
    if not found:  # out of tries: best fit
        rest, used = room, []
        for s in sizes:
            if n := min(rest // s, left[s]):
                used.append((s, n))
                rest -= n * s
        found[rest] = tuple(used)
    return sorted(found.items())[:limit]


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = 1500,
                  tries: int = 600, branches: int = 3) -> Plan:
    """Few sequences for the histogram ``counts`` (length -> pieces).

    ``nodes`` bounds the steps of the search over all branches; the incumbent
    is returned when they run out or the waste bound proves it best.
    """
    counts = {s: n for s, n in counts.items() if n > 0}
    if any(s < 1 or s > capacity for s in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    total = sum(s * n for s, n in counts.items())
    least = -(-total // capacity)
    best = best_fit(counts, capacity)
    bins = sum(t for _, t in best)
    stack: list[tuple[dict[int, int], Plan, int, int]] = [(counts, [], 0, 0)]
    while stack and nodes > 0 and bins > least:
        left, plan, used, waste = stack.pop()
        if waste > (bins - 1) * capacity - total:  # cannot beat the incumbent
            continue
        if not left:
            if used < bins:
                best, bins = plan, used
            continue
        nodes -= 1
        top = max(left)
        rest = Counter(left)
        rest[top] -= 1
        options = completions(rest, capacity - top, branches, tries)
        for over, filling in reversed(options):  # least waste is popped first
            after, pieces = Counter(left), Counter(dict(filling))
            pieces[top] += 1
            step = _apply(after, pieces)
            stack.append(({s: n for s, n in after.items() if n}, plan + [step], used + step[1],
                          waste + over * step[1]))
    return best


def _slots(plan: Plan) -> pd.DataFrame:
    """One row a filling and length: ranks ``low`` to ``high`` of that length go
    there, ``times`` bins from ``first`` on, ``n`` side by side from ``offset``."""
    ranks, rows, first = Counter(), [], 0
    for filling, times in plan:
        offset = 0
        for size, n in filling:
            rows.append((size, ranks[size], ranks[size] + n * times, first, n, offset))
            ranks[size] += n * times
            offset += n * size
        first += times
    return pd.DataFrame(rows, columns=["size", "low", "high", "first", "n", "offset"]).sort_values(["size", "low"])


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of at most ``capacity`` ids, with their running number in task and length.

    A document is its ids and ``end_id``. Only longer documents are cut; the
    first piece is the shorter one. Null text counts as empty.
    """
    def cut(batches) -> Iterator[pa.RecordBatch]:
        encoder, seen, task = encoder_for(tokenizer), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            names = batch.column(0)
            for i, j, data, offsets in text_slices(batch.column(1)):
                ids, bounds = encoder.encode(data, offsets)
                out = {k: [] for k in ("row", "piece", "start", "length", "ids_crc32", "place")}
                for r in range(j - i):
                    own = np.append(ids[bounds[r]:bounds[r + 1]], np.uint32(end_id)).astype("<u4")
                    at, k = 0, 0
                    while at < len(own):
                        size = capacity if k else (len(own) - 1) % capacity + 1
                        for name, x in zip(out, (i + r, k, at, size, zlib.crc32(own[at:at + size].tobytes()), seen[size])):
                            out[name].append(x)
                        seen[size] += 1
                        at, k = at + size, k + 1
                rows = pa.array(out.pop("row"), pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": names.take(rows), "piece": pa.array(out["piece"], pa.int32()),
                    "start": out["start"], "length": out["length"], "ids_crc32": out["ids_crc32"],
                    "task": pa.array([task] * len(rows), pa.int32()), "place": out["place"]})

    return ready(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(cut), PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    Returns a row a piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Null or empty text is a document of the end id alone;
    null and repeated doc_ids are packed like others; other columns are not
    looked at; an empty table gives no rows.

    The pieces are written once, which fixes their numbers within task and
    length. A piece's rank among all of its length is that number plus the
    counts of earlier tasks, so no length is gathered in one place. The plan
    (at most ``capacity`` lengths, each filling at most sqrt(2 * capacity)
    different ones) is what tasks get.
    """
    pieces = saved(token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(complete_bins(counts, capacity))
    before = by_task.select("length", "task", (F.sum("n").over(
        Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    spark = docs.sparkSession
    plan = spark.sparkContext.broadcast({c: slots[c].to_numpy(np.int64) for c in slots})

    def place(batches):
        p = plan.value
        span = int(p["high"].max()) + 1 if len(p["high"]) else 1
        keys = p["size"] * span + p["low"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("place").to_numpy() + b.column("before").to_numpy()
            k = np.searchsorted(keys, length * span + rank, "right") - 1
            bin_, side = np.divmod(rank - p["low"][k], p["n"][k])
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(p["first"][k] + bin_), pa.array(p["offset"][k] + side * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return pieces.join(saved(before, "piece-counts"), ["length", "task"]).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(packed: DataFrame, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array), doc_ids and their offsets.

    Encodes the documents again and gathers at most ``capacity`` ids a sequence.
    ``docs`` must hold each doc_id once.
    """
    def encode(batches):
        encoder = encoder_for(tokenizer)
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(1)):
                ids, bounds = encoder.encode(data, offsets)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(i, j - i),
                    "all_ids": pa.array([np.append(ids[a:b], np.uint32(end_id)).astype(np.int64)
                                         for a, b in zip(bounds[:-1], bounds[1:])], pa.list_(pa.int64()))})

    encoded = ready(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, all_ids array<long>")
    part = F.expr("slice(all_ids, cast(start + 1 as int), cast(length as int))")
    rows = packed.join(encoded, "doc_id").select("sequence_id", F.struct("offset", "doc_id", part.alias("ids")).alias("p"))
    return rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list("p")).alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"),
        F.col("p.offset").alias("offsets"))
