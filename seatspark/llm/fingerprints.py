"""Document fingerprints: improbable byte windows in chained Bloom filters.

Every window of ``WINDOW`` bytes has an entropy; how often its level occurs
in the corpus says how improbable it is. Along a text, the least probable of
each ``SPAN`` windows in a row gets a vote (ties go to the smaller hash, so
the choice depends on the bytes around it alone), and windows with ``VOTES``
votes are its features. Five bits of each feature go into a Bloom filter; after ``FEATURES`` of them the next filter of the chain begins. Two
fingerprints are compared by the bits that their filters share beyond chance.

Entropies of all windows come from one pass of vector operations: sliding on
by a byte changes the sum of n log2 n by two terms, which depend on how often
the leaving and the entering byte occur within the window. Sums are fixed
point integers, so a window has one entropy wherever it stands.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import even_ranges, frugal, ready, saved
from .textops import SLICE_BYTES, byte_values, mix, powers, run_hashes, text_slices

WINDOW, SPAN, VOTES = 16, 16, 5
#: In its first HEAD bytes a text needs one vote only, so that a short text has features enough.
HEAD = 512
LEVELS = 512
#: Windows of less than this share of the largest entropy (runs of few characters) are no features.
WEAK = 0.25
BITS, HASHES, FEATURES = 2048, 5, 160
#: Texts of fewer bytes, and those without features, take all their windows of SMALL bytes.
SHORT, SMALL = 64, 5
#: Share of the overlap beyond chance that counts as noise.
NOISE = 0.1

_ONE = 1 << 24
_STEP = np.array([0] + [round(_ONE * (k * math.log2(k) - ((k - 1) * math.log2(k - 1) if k > 1 else 0)))
                        for k in range(1, WINDOW + 1)], np.int64)
_TOP = int(_STEP.sum())
_VALUES = byte_values(np.ones(256, bool), fold_case=False)


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Entropy of each window of ``data``, as a level from 0 (one byte repeated) to LEVELS - 1."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ahead, behind = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for k in range(1, WINDOW):
        same = (data[:-k] == data[k:]).view(np.uint8)
        ahead[:-k] += same
        behind[k:] += same
    first = np.bincount(data[:WINDOW])
    sums = np.empty(n, np.int64)
    sums[0] = np.cumsum(_STEP)[first].sum()
    sums[1:] = _STEP[behind[WINDOW:]] - _STEP[ahead[:n - 1]]
    np.cumsum(sums, out=sums)
    return (_TOP - sums) * (LEVELS - 1) // _TOP


def _blocks(data: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, bytes, their rows) in blocks of bounded size, which overlap so that
    every SPAN windows in a row lie in one of them."""
    for at in range(0, len(data), SLICE_BYTES):
        end = at + SLICE_BYTES + WINDOW + SPAN - 2
        yield at, data[at:end], rows[at:end]


def _rows(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))


def level_counts(texts: DataFrame) -> np.ndarray:
    """Windows of all ``texts`` (first column) at each entropy level."""
    def count(batches):
        counts = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                for _, block, rows in _blocks(data, _rows(offsets)):
                    own = entropy_levels(block)[:SLICE_BYTES]
                    counts += np.bincount(own[rows[:len(own)] == rows[WINDOW - 1:WINDOW - 1 + len(own)]], minlength=LEVELS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"level": pa.array(used.astype(np.int32)), "n": counts[used]})

    out = np.zeros(LEVELS, np.int64)
    for r in ready(texts).mapInArrow(frugal(count), "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        out[r["level"]] = r["n"]
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy level, rarest first; weak levels have rank LEVELS, which no feature has."""
    rank = np.empty(LEVELS, np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(LEVELS)
    rank[:math.ceil(WEAK * LEVELS)] = LEVELS
    return rank


def _window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * up, dtype=np.uint64)])
    return mix((sums[size:] - sums[:n]) * down[:n])


def _voted(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and hashes of the windows with enough votes, in order."""
    votes, found, rows = np.zeros(len(data), np.uint8), [], _rows(offsets)
    for at, block, row in _blocks(data, rows):
        spans = len(block) - WINDOW - SPAN + 2
        if spans <= 0:
            continue
        h = _window_hashes(block, WINDOW)
        level = rank[entropy_levels(block)].astype(np.uint64)
        low = level << np.uint64(54) | h >> np.uint64(42) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while step < SPAN:  # the least key of 2, 4, 8, ... windows in a row
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        won = (low[row[:spans] == row[-spans:]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        tally = np.bincount(won[level[won] < LEVELS], minlength=len(h)).astype(np.uint8)
        votes[at:at + len(h)] += tally
        near = np.flatnonzero(tally)
        found.append((near + at, h[near]))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    places, hashes = (np.concatenate(x) for x in zip(*found))
    places, first = np.unique(places, return_index=True)
    owner = rows[places]
    good = votes[places] >= np.where(places - offsets[owner] < HEAD, 1, VOTES)
    return owner[good], hashes[first][good]


def _small_windows(data: np.ndarray) -> np.ndarray:
    """Hashes of all windows of SMALL bytes, or of a shorter text as a whole."""
    if 0 < len(data) < SMALL:
        return run_hashes(_VALUES[data], np.zeros(1, np.int64))
    return _window_hashes(data, SMALL)


def features(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' features in order, and each text's bounds among them.

    A feature that a text repeats is hashed with its count so far, so a text's features are a bag.
    """
    owner, hashes = _voted(data, offsets, rank)
    sizes = np.diff(offsets)
    short = np.flatnonzero((sizes > 0) & ((sizes < SHORT) | (np.bincount(owner, minlength=len(sizes)) == 0)))
    if len(short):
        keep = ~np.isin(owner, short)
        own = [_small_windows(data[offsets[r]:offsets[r + 1]]) for r in short.tolist()]
        owner = np.concatenate([owner[keep], np.repeat(short, [len(h) for h in own])])
        hashes = np.concatenate([hashes[keep], *own])
        order = np.argsort(owner, kind="stable")
        owner, hashes = owner[order], hashes[order]
    if not len(hashes):
        return hashes, np.zeros(len(offsets), np.int64)
    order = np.lexsort((hashes, owner))
    begins = np.ones(len(order), bool)
    begins[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    again = np.empty(len(order), np.int64)
    again[order] = np.arange(len(order)) - np.repeat(np.flatnonzero(begins), np.diff(np.append(np.flatnonzero(begins), len(order))))
    return mix(hashes + again.astype(np.uint64)), np.searchsorted(owner, np.arange(len(offsets)))


def digests(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """Each text's chain of Bloom filters: a uint8 matrix, a filter a row; none for an empty text."""
    hashes, bounds = features(data, offsets, rank)
    counts = np.diff(bounds)
    filters = -(-counts // FEATURES)
    first = np.concatenate([[0], np.cumsum(filters)])
    ordinal = np.arange(len(hashes)) - np.repeat(bounds[:-1], counts)
    which = np.repeat(first[:-1], counts) + ordinal // FEATURES
    bits = np.zeros((int(first[-1]), BITS), bool)
    for k in range(HASHES):
        bits[which, (hashes >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def _best(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the filters of ``a``, by their bits, of the largest likeness to a filter of ``b``."""
    total = weight = 0.0
    n_b = np.bitwise_count(b).sum(1, dtype=np.int64)
    for row in a:
        n_a = int(np.bitwise_count(row).sum(dtype=np.int64))
        shared = np.bitwise_count(b & row).sum(1, dtype=np.int64)
        chance, most = n_a * n_b / BITS, np.maximum(n_a, n_b)
        floor = chance + NOISE * (most - chance)
        total += n_a * max(0.0, float(((shared - floor) / (most - floor)).max()))
        weight += n_a
    return min(1.0, total / weight)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the bits that two chains share beyond chance; the smaller of both directions, 1 for equal chains."""
    if np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    return min(_best(a, b), _best(b, a))


def as_text(digest: np.ndarray) -> str:
    return base64.b64encode(digest.tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BITS // 8)


def fit_rarity(docs: DataFrame) -> np.ndarray:
    """The rarity ranks of all ``docs``' windows, to be used for every fingerprint that is compared."""
    return rarity(level_counts(docs.select("text")))


def fingerprint(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """doc_id and fingerprint (filters in base64) of every document. Null text counts as empty: an empty string."""
    def make(batches):
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([as_text(d) for d in digests(data, offsets, rank)], pa.string())],
                    ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ready(docs).select("doc_id", "text").mapInArrow(make, f"doc_id {kind}, fingerprint string")


_PAIR = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
         "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
_PAIR_SQL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")


def _digests_of(texts: list[str], rank: np.ndarray) -> list[np.ndarray]:
    out = []
    for _, _, data, offsets in text_slices(pa.array(texts, pa.large_string())):
        out += digests(data, offsets, rank)
    return out


def _pairs(ids: list, texts: list[str], own: list[np.ndarray], after: list[str], next_: list[np.ndarray],
           rank: np.ndarray) -> dict[str, pa.Array]:
    """The result columns of texts and of the texts that follow them."""
    edited = [t[:len(t) - len(t) // 2] + a[:len(t) // 2] for t, a in zip(texts, after)]
    made = _digests_of(edited, rank)
    out = (ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited],
           [as_text(d) for d in own], [as_text(d) for d in made],
           [likeness(a, b) for a, b in zip(own, made)], [likeness(a, b) for a, b in zip(own, next_)])
    return {name: pa.array(values, kind) for (name, kind), values in zip(_PAIR.items(), out)}


GROUP_BYTES = 4 << 20  # of text in one group of consecutive documents, about; a task holds one or a few
MOST_GROUPS = 200_000


def _grouped(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` (doc_id, text) with ``h``, the hash of the text, and ``g``: groups of consecutive documents.

    Documents are in descending doc_id, null last, equal ones by ``h``; groups
    are numbered in that order. Ids come in ranges of even numbers of rows; an
    id (or null) that fills more than one group is cut by ranges of the hash.
    """
    n, nulls, size = rows.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()), F.sum(F.octet_length("text"))).first()
    share = max(1, -(-n * GROUP_BYTES // max(size or 0, 1)), -(-n // MOST_GROUPS))
    ranges = even_ranges(rows.select("doc_id"), share)
    firsts = np.array([f for f, _ in ranges], np.int64)
    parts = np.array([-(-m // share) for _, m in ranges[::-1]] + [max(1, -(-nulls // share))], np.int64)
    begins = np.cumsum(parts) - parts  # of each range, the last first, then of the null ids

    @F.pandas_udf("int")
    def group_of(ids: pd.Series, null: pd.Series, h: pd.Series) -> pd.Series:
        at = len(firsts) - np.maximum(np.searchsorted(firsts, ids.to_numpy(), "right"), 1)
        at = np.where(null.to_numpy(), len(firsts), np.minimum(at, len(firsts)))
        within = ((h.to_numpy() >> 33) + (1 << 30)) * parts[at] >> 31
        return pd.Series((begins[at] + within).astype(np.int32))

    h = F.xxhash64("text")
    grouped = rows.select("doc_id", "text", h.alias("h"), group_of(
        F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNull(), h).alias("g"))
    return grouped, int(parts.sum())


def _with_followers(grouped: DataFrame) -> DataFrame:
    """``grouped`` and, as the last row of each group (``last`` = 1), a copy of the document that follows the group.

    There is a row a group, so the copies are few; they are found by their keys.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), (-1 - F.col("doc_id")).alias("down"), "h")
    keys = grouped.groupBy("g").agg(F.min(place).alias("first")).collect()  # a row a group
    keys.sort(key=lambda r: r["g"])
    if not keys:
        return grouped.withColumn("last", F.lit(0))
    listed = [(r["g"], None if r["first"]["none"] else -1 - r["first"]["down"], r["first"]["h"], keys[k - 1]["g"])
              for k, r in enumerate(keys)]  # the first group follows the last one
    firsts = F.broadcast(grouped.sparkSession.createDataFrame(listed, "g int, first_id long, first_h long, before int"))
    found = (grouped.join(firsts, "g").where(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
             .groupBy("before").agg(F.min(F.struct("text", "doc_id", "h")).alias("x")))
    copies = saved(found, "followers").select("x.doc_id", "x.text", "x.h", F.col("before").alias("g"), F.lit(1).alias("last"))
    return grouped.withColumn("last", F.lit(0)).unionByName(copies)


def _walk(rank: np.ndarray):
    """Task over (g, last, doc_id, text) in order: the result rows."""
    def walk(batches):
        held = None  # the last document seen, whose next one is yet to come
        for batch in batches:
            column = batch.column(3).cast(pa.large_string()).fill_null("")
            groups, lasts, ids = (batch.column(k).to_pylist() for k in range(3))
            for i, j, data, offsets in text_slices(column):
                seen = list(zip(groups[i:j], lasts[i:j], ids[i:j], column.slice(i, j - i).to_pylist(), digests(data, offsets, rank)))
                seen = ([held] if held else []) + seen
                pairs = [(a, b) for a, b in zip(seen, seen[1:]) if not a[1]]
                held = seen[-1] if not seen[-1][1] else None
                if pairs:
                    own, after = zip(*pairs)
                    yield pa.RecordBatch.from_pydict(_pairs(
                        [x[2] for x in own], [x[3] for x in own], [x[4] for x in own],
                        [x[3] for x in after], [x[4] for x in after], rank))

    return walk


def compare_with_edits(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """Fingerprints of all ``docs`` (doc_id, text) and of their edited texts, with their likeness.

    A text is edited by replacing its last floor(n_chars / 2) code points by
    the first as many (or all) of the next document, in descending doc_id; the
    last one is followed by the first. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. Null text counts
    as empty; an empty text has an empty fingerprint, which is like another
    empty one (1) and like nothing else (0). Rows that repeat a doc_id follow
    each other by a hash of their text, null doc_ids come last; a single
    document follows itself. Other columns are not looked at; an empty table
    gives no rows.

    Texts are shuffled once, by groups of consecutive documents; each group also
    gets a copy of the document after it, so groups are walked through on their own.
    """
    if rank is None:
        rank = fit_rarity(docs)
    grouped, groups = _grouped(ready(docs).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")))
    rows = _with_followers(grouped).repartition(groups, "g").sortWithinPartitions(
        "g", "last", F.col("doc_id").desc_nulls_last(), "h", "text")
    return rows.select("g", "last", "doc_id", "text").mapInArrow(frugal(_walk(rank)), _PAIR_SQL)
