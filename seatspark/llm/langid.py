"""Language ID by a byte convolutional network, trained in numpy.

Filters of several widths slide over the bytes of fixed-length windows; the
largest response of each filter in a window feeds a softmax. As the input is
one-hot, a filter's response at a place is a sum of one table row a byte, so
prediction is table look-ups; neighbouring bytes share one pair table.
A text's label is that of its windows' mean log-probability, weighted by their
lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import frugal, ready, saved
from .textops import text_slices

UNDETERMINED = "und"


@dataclass
class ByteCnn:
    """labels; tables[w]: (w, 256, filters); bias[w]; the softmax layer; window length."""

    labels: list[str]
    tables: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    window: int

    def pair_tables(self) -> dict[int, list[np.ndarray]]:
        """Summed rows of byte pairs; an odd width ends in a table of single bytes."""
        made = {}
        for w, t in self.tables.items():
            made[w] = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1) if k + 1 < w else t[k]
                       for k in range(0, w, 2)]
        return made


def _forward(net: ByteCnn, x: np.ndarray):
    """Pooled responses of windows ``x`` (n, length), and where each maximum stood."""
    pooled, places = [], []
    for w, t in net.tables.items():
        span = x.shape[1] - w + 1
        r = sum(t[k][x[:, k:k + span]] for k in range(w)) + net.bias[w]
        at = r.argmax(1)
        pooled.append(np.maximum(np.take_along_axis(r, at[:, None, :], 1)[:, 0, :], 0))
        places.append(at)
    return np.concatenate(pooled, 1), places


def train(texts: list[bytes], labels: list[str], widths=(2, 3, 4), filters: int = 8, window: int = 256,
          epochs: int = 6, seed: int = 7) -> ByteCnn:
    """Fit by Adam on windows of labelled texts (at most eight windows a text)."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    xs, ys = [], []
    for text, label in zip(texts, labels):
        for at in range(0, max(1, min(len(text), 8 * window)), window):
            part = text[at:at + window]
            if len(part) >= window // 4 or at == 0:
                xs.append(np.frombuffer(part.ljust(window, b" "), np.uint8))
                ys.append(names.index(label))
    x, y = np.stack(xs), np.array(ys)
    net = ByteCnn(names, {w: rng.normal(0, 0.1, (w, 256, filters)).astype(np.float32) for w in widths},
                  {w: np.zeros(filters, np.float32) for w in widths},
                  rng.normal(0, 0.3, (filters * len(widths), len(names))).astype(np.float32),
                  np.zeros(len(names), np.float32), window)
    params = [*net.tables.values(), *net.bias.values(), net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(order), 64):
            rows = order[k:k + 64]
            xb, yb = x[rows], y[rows]
            pooled, places = _forward(net, xb)
            z = pooled @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            d = (p @ net.out.T) * (pooled > 0)
            grads_t, grads_b = [], []
            for i, (w, t) in enumerate(net.tables.items()):
                g, part = np.zeros_like(t), d[:, i * filters:(i + 1) * filters]
                f = np.broadcast_to(np.arange(filters), part.shape)
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(xb, places[i] + j, 1), f), part)
                grads_t.append(g)
                grads_b.append(part.sum(0))
            step += 1
            for q, g, (m, v) in zip(params, [*grads_t, *grads_b, pooled.T @ p, p.sum(0)], moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= 0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return net


def log_probabilities(net: ByteCnn, pairs: dict[int, list[np.ndarray]], data: np.ndarray,
                      offsets: np.ndarray) -> np.ndarray:
    """Mean log-probabilities (rows, labels) of whole texts; zeros for empty ones."""
    n, size = len(offsets) - 1, net.window
    lengths = np.diff(offsets)
    counts = -(-lengths // size)
    total = int(counts.sum())
    sums = np.zeros((n, len(net.labels)))
    if not total:
        return sums
    owner = np.repeat(np.arange(n), counts)
    within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[owner] + within * size
    weight = np.minimum(size, offsets[owner + 1] - starts)
    padded = np.concatenate([data, np.full(size, 32, np.uint8)])
    logs = np.empty((total, len(net.labels)))
    step = 256
    for k in range(0, total, step):
        x = padded[starts[k:k + step, None] + np.arange(size)]
        x[np.arange(size) >= weight[k:k + step, None]] = 32  # a short window ends in spaces, as in training
        x = x.astype(np.int32)
        both = x[:, :-1] * 256 + x[:, 1:]
        pooled = []
        for w, tables in pairs.items():
            span = size - w + 1
            r = tables[0][both[:, :span]]
            for i, t in enumerate(tables[1:], 1):
                r += t[both[:, 2 * i:2 * i + span]] if len(t) > 256 else t[x[:, 2 * i:2 * i + span]]
            pooled.append(np.maximum(r.max(1) + net.bias[w], 0))
        z = np.concatenate(pooled, 1) @ net.out + net.out_bias
        z -= z.max(1, keepdims=True)
        logs[k:k + step] = z - np.log(np.exp(z).sum(1, keepdims=True))
    np.add.at(sums, owner, logs * weight[:, None])
    return sums / np.maximum(lengths, 1)[:, None]


def spread_windows(text: str, windows: int, window: int) -> Column:
    """UTF-8 of the text, or one window at a hashed place from each of ``windows`` equal parts if it has more."""
    data = F.col(text).cast("binary")
    n = F.ceil(F.length(data) / window)
    places = (F.floor((j + F.pmod(F.xxhash64(text, F.lit(j)), F.lit(1 << 20)) / (1 << 20)) * n / windows)
              for j in range(windows))
    parts = [F.substring(data, (at * window + 1).cast("int"), F.lit(window)) for at in places]
    return F.when(n <= windows, data).otherwise(F.concat(*parts))


def fit_language_model(docs: DataFrame, training: Column, per_label: int = 800, windows: int = 8,
                       window: int = 256, **options) -> ByteCnn | None:
    """Fit on a bounded sample of labelled rows: ``per_label`` texts a language at most.

    The sample is the different texts of smallest hash in each language, so it
    does not depend on the row order; of longer texts ``windows`` windows are
    learnt from, at hashed places of the whole text. Null labels and null or
    blank texts are not used. Every label is learnt. None if no row is left.
    """
    spark = docs.sparkSession
    rows = docs.where(training).where("lang is not null and text is not null").where(
        F.col("text").rlike("(?U)\\S")).select(
        "lang", "text", F.xxhash64("text").alias("key"))
    keys = saved(rows.select("lang", "key").distinct(), "language-keys")  # copies count once

    def lowest(df: DataFrame, cuts: dict[str, int]) -> DataFrame:
        """Rows whose key is at most their label's cut."""
        low = spark.createDataFrame(list(cuts.items()), "lang string, cut long")  # a row a label
        return df.join(F.broadcast(low), "lang").where("key <= cut").drop("cut")

    kinds = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    most = {r["lang"]: r["n"] for r in kinds}
    cuts, share, left = {}, 2.0, set(most)
    while left:  # about twice the sample comes to the driver; a label that got too little is asked again, more widely
        found = {}
        asked = {k: min((1 << 63) - 1, int(share * per_label / most[k] * (1 << 64)) - (1 << 63)) for k in left}
        for r in lowest(keys, asked).collect():
            found.setdefault(r["lang"], []).append(r["key"])
        for lang, got in found.items():
            if len(got) >= min(per_label, most[lang]):
                cuts[lang] = sorted(got)[:per_label][-1]
                left.discard(lang)
        share *= 4
    if not cuts:
        return None
    sample = lowest(rows, cuts).select("lang", "key", spread_windows("text", windows, window).alias("text")).groupBy(
        "lang", "key").agg(F.min("text").alias("text")).collect()
    sample.sort(key=lambda r: (-most[r["lang"]], r["lang"], r["key"]))
    sample = [(bytes(r["text"]), r["lang"]) for r in sample if r["text"].strip()]
    if not sample:
        return None
    return train([t for t, _ in sample], [k for _, k in sample], window=window, **options)


def predict_language(docs: DataFrame, net: ByteCnn | None) -> DataFrame:
    """``docs`` (their columns but for lang_pred, score) with lang_pred and score.

    Whole texts are read in windows. ``und`` with score 0 if the text is null,
    has no letter, or there is no model. Other columns may be null or repeated.
    """
    docs = docs.drop("lang_pred", "score")
    spark = docs.sparkSession
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    shared = spark.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def predict(batches):
        model = shared.value
        pairs = model.pair_tables() if model else {}
        ascii_letter = np.zeros(256, bool)
        ascii_letter[65:91] = ascii_letter[97:123] = True
        for batch in batches:
            column = batch.column(at)
            labels, scores = [], []
            for i, j, data, offsets in text_slices(column):
                if model is None:
                    labels += [UNDETERMINED] * (j - i)
                    scores += [0.0] * (j - i)
                    continue
                logs = log_probabilities(model, pairs, data, offsets)
                best = logs.argmax(1)
                p = np.exp(logs - logs.max(1, keepdims=True))
                p = (p / p.sum(1, keepdims=True))[np.arange(j - i), best]
                seen = np.concatenate([[0], np.cumsum(ascii_letter[data])])
                lettered = seen[offsets[1:]] > seen[offsets[:-1]]
                for r in np.flatnonzero(~lettered):
                    lettered[r] = any(c.isalpha() for c in data[offsets[r]:offsets[r + 1]].tobytes().decode())
                labels += [model.labels[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)]
                scores += np.where(lettered, p, 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return ready(docs).mapInArrow(frugal(predict), schema)


def has_letter(text: Column) -> Column:
    """Whether a text has a letter; never for null."""
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the doc_id's text leaves ``part`` when divided by ``parts``; never for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify_languages(docs: DataFrame, parts: int = 5, part: int = 0) -> DataFrame:
    """Fit on the rows that are not held out and predict all rows; adds held_out, lang_pred, score."""
    out = held_out(F.col("doc_id"), parts, part)
    net = fit_language_model(docs, ~out)
    return predict_language(docs.withColumn("held_out", out), net)
