"""Importance resampling towards a target's word distribution, on hashed word runs.

A text's features are its runs of 1 to ``most`` words, each dealt to one of
``buckets`` buckets by the CRC-32 of its UTF-8 bytes. CRCs are computed for
whole matrices: the distinct features of a slice of texts are grouped by
length, a group is a two-dimensional uint8 array, and all its CRCs go on byte
by byte, a column at a time, through the 256-entry table; the buckets are then
scattered back to the features' places.

One pass over the corpus and one over the target count the buckets (partial
counts in the tasks, ``buckets`` rows at the driver). A second pass sums the
buckets' gains over each text. Ranks of the draw are positions in a range
partitioning of (score, id) rows; texts never travel.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ids import next_ids
from .shared import frugal, ready, saved
from .textops import ALNUM, text_slices

#: Features of more bytes are rare; each takes one call of zlib.
LONG = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    """CRC-32 of every byte (reflected polynomial 0xEDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def crc_columns(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a uint8 matrix, a column at a time."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = _TABLE[(crc & np.uint32(255)) ^ column] ^ (crc >> np.uint32(8))
    return ~crc


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a uint8 matrix without zero bytes, and each row's place among them."""
    length = rows.shape[1]
    if length <= 8:
        padded = np.zeros((len(rows), 8), np.uint8)
        padded[:, :length] = rows
        keys = padded.view(np.uint64).ravel()
    else:
        keys = np.ascontiguousarray(rows).view(f"S{length}").ravel()
    _, first, place = np.unique(keys, return_index=True, return_inverse=True)
    return rows[first], place


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte runs of ``data``, by matrices of equal length."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts) if len(order) else ():
        length = int(lengths[group[0]])
        if length > LONG:
            out[group] = [zlib.crc32(data[s:s + length].tobytes()) for s in starts[group].tolist()]
            continue
        rows = np.lib.stride_tricks.sliding_window_view(data, length)[starts[group]]
        distinct, place = _distinct(rows)
        out[group] = crc_columns(distinct)[place]
    return out


def spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words joined by single spaces: bytes, starts and ends of words, bounds of each row's words."""
    low = _LOWER[data]
    inside = ALNUM[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[at] = inside[at]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offsets)
    word = np.cumsum(begins)[inside] - 1
    lengths = np.bincount(word, minlength=len(starts)).astype(np.int64)
    joined = np.full(int(lengths.sum()) + len(starts), 32, np.uint8)
    joined[np.arange(len(word)) + word] = low[inside]
    ends = np.cumsum(lengths + 1) - 1
    return joined, ends - lengths, ends, bounds


def feature_buckets(data: np.ndarray, offsets: np.ndarray, most: int, buckets: int) -> Iterator[tuple]:
    """For runs of 1 to ``most`` words: (buckets of all runs, bounds of each row's runs, bounds of its words)."""
    joined, starts, ends, words = spaced_words(data, offsets)
    row = np.repeat(np.arange(len(words) - 1), np.diff(words))
    for k in range(1, most + 1):
        size = max(len(starts) - k + 1, 0)
        whole = np.flatnonzero(row[:size] == row[k - 1:k - 1 + size])
        found = crcs(joined, starts[whole], ends[whole + k - 1] - starts[whole]) % np.uint32(buckets)
        yield found, np.searchsorted(whole, words), words


def bucket_counts(texts: DataFrame, most: int, buckets: int) -> np.ndarray:
    """Features of all ``texts`` (first column) in each bucket: at most ``buckets`` rows reach the driver."""
    def count(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                for found, _, _ in feature_buckets(data, offsets, most, buckets):
                    counts += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used.astype(np.int32)), "n": counts[used]})

    out = np.zeros(buckets, np.int64)
    for r in ready(texts).mapInArrow(frugal(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share over the source's), for each bucket, in doubles."""
    size, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, most: int) -> DataFrame:
    """doc_id, n_features, n_words and weight (sum of gains) of every document."""
    def weigh(batches):
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(1)):
                features, weight, words = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64), None
                for found, bounds, word_bounds in feature_buckets(data, offsets, most, len(gain)):
                    sums = np.concatenate([[0], np.cumsum(gain[found])])
                    features += np.diff(bounds)
                    weight += sums[bounds[1:]] - sums[bounds[:-1]]
                    words = np.diff(word_bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(features), pa.array(words), pa.array(weight)],
                    ["doc_id", "n_features", "n_words", "weight"])

    return ready(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(
        weigh, "doc_id long, n_features long, n_words long, weight long")


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, percent: int = 10,
             least_words: int = 20, seed: str = "2024") -> DataFrame:
    """Draw ``percent`` of ``docs`` (doc_id, text) towards the texts of ``target``, without replacement.

    Returns every document's doc_id, n_features, weight, score and rank: the
    place of the drawn ones (highest weight plus Gumbel noise of the id first,
    ties to the smaller doc_id), else null. Null and empty texts have no
    features and weight 0; documents of fewer than ``least_words`` words are
    never drawn. A null doc_id counts as an empty id in the noise and comes
    last among ties; rows that repeat a doc_id are documents of their own, of
    the same noise, fewer features first. Other columns are not looked at;
    empty tables count no features, and give no rows if ``docs`` is one.
    """
    if most < 1 or buckets < 1:
        raise ValueError("one word and one bucket at least")
    gain = gains(bucket_counts(docs.select("text"), most, buckets), bucket_counts(target.select("text"), most, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
                                  256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = saved(weights(docs, gain, most).withColumn("score", F.col("weight") + noise), "scores")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    order = {"_out": F.when(able, 0).otherwise(1), "_down": -F.col("score"), "_null": F.col("doc_id").isNull().cast("int")}
    ranked = next_ids(scored.withColumns(order), [*order, "doc_id", "n_features", "weight"], 0, "rank")
    return ranked.select("doc_id", "n_features", "weight", "score",
                         F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` draws, all columns kept. ``docs`` must hold each doc_id once."""
    ids = resample(docs, target, **options).where("rank is not null").select("doc_id")
    return docs.join(ids, "doc_id", "left_semi").select(*docs.columns)
