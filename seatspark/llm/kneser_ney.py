"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

Bigrams are hashed and counted within tasks, and the counts are dealt out by
hash and summed. Each bucket becomes a file of sorted hash arrays in the shared
folder, which workers map into memory. A second pass over the training texts
looks up each bigram's count c: an occurrence adds 1 / c, so that all
occurrences of a bigram add up to one; this gives each word's number of
different predecessors and successors without another shuffle of bigrams.
A third pass scores the texts.

Hashes have 64 bits, of which a bucket's file keeps 48 beside its number.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import commit_file, frugal, local_path, open_folder, ready, scratch
from .textops import BLANK, byte_values, mix, text_slices, word_hashes

BLOCK_TOKENS = 1 << 21  # tokens that a task counts together
BUCKET_BYTES = 8 << 20  # of training text for each bucket, about
LOW_BITS = 48
BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x38B34AE5E6546B64)
_VALUES = byte_values(~BLANK)


def _tokens(column):
    """(first row, token hashes, previous tokens, bounds by row) of slices; each row ends in END."""
    for i, _, data, offsets in text_slices(column):
        words, bounds = word_hashes(data, offsets, _VALUES)
        tokens = np.insert(words, bounds[1:], END)
        ends = bounds[1:] + np.arange(1, len(bounds))
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[np.concatenate([[0], ends[:-1]])] = BEGIN
        yield i, tokens, before, np.concatenate([[0], ends])


def _pairs(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens * np.uint64(0xC2B2AE3D27D4EB4F))


def _blocks(batches):
    """Tokens and their predecessors, BLOCK_TOKENS or so at a time."""
    parts, size = [], 0
    for batch in batches:
        for _, tokens, before, _ in _tokens(batch.column(0)):
            parts.append((tokens, before))
            size += len(tokens)
            if size >= BLOCK_TOKENS:
                yield tuple(map(np.concatenate, zip(*parts)))
                parts, size = [], 0
    if parts:
        yield tuple(map(np.concatenate, zip(*parts)))


def _six(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(blobs: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _dealt(hashes: np.ndarray, columns: list[np.ndarray], bits: int):
    """A row a bucket (top bits of the sorted hashes): low hash bits, and the columns' bytes."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        x, y = edges[b], edges[b + 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b], pa.int32()), pa.array([_six(hashes[x:y])], pa.binary())]
            + [pa.array([c[x:y].tobytes()], pa.binary()) for c in columns],
            ["bucket", "hashes", *(f"c{k}" for k in range(len(columns)))])


def _buckets(batches, n: int):
    """(bucket, hash blobs, column blobs) of a task's rows, which come sorted by bucket."""
    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(n + 2))))
    for bucket, group in itertools.groupby(rows, key=lambda r: r[0]):
        columns = list(zip(*group))
        yield bucket, _from_six(columns[1]), [b"".join(c) for c in columns[2:]]


def _index(low: np.ndarray) -> np.ndarray:
    """Where each value of the top 16 of 48 bits begins among sorted hashes."""
    return np.searchsorted(low >> np.uint64(32), np.arange(65537, dtype=np.uint64)).astype(np.uint32)


def _narrow(column: np.ndarray) -> np.ndarray:
    """Whole numbers in 32 bits if all of them fit, else in 64."""
    return column.astype(np.uint32) if column.max(initial=0) < 1 << 32 else column


class HashFile:
    """A bucket's file: counts of entries, their index, low hash halves, columns; memory-mapped.

    The head holds the number of entries, and the type of each column.
    """

    @staticmethod
    def parts(low: np.ndarray, columns: list[np.ndarray]) -> list[bytes]:
        head = np.zeros(8, np.int64)
        head[0], head[1:1 + len(columns)] = len(low), [ord(c.dtype.char) for c in columns]
        return [head.tobytes(), _index(low).tobytes(), (low & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                *(c.tobytes() for c in columns)]

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, *kinds = raw[:64].view(np.int64).tolist()
        at = 64 + 4 * 65537
        self.index, self.low = raw[64:at].view(np.uint32), raw[at:at + 4 * n].view(np.uint32)
        at += 4 * n
        self.columns = []
        for kind in (np.dtype(chr(k)) for k in kinds if k):
            # a copy-free view; entries may lie unaligned in the file
            self.columns.append(np.ndarray(n, kind, raw, at))
            at += n * kind.itemsize

    def find(self, low: np.ndarray) -> np.ndarray:
        """Places of 48-bit hashes; -1 for those that are not here."""
        top = (low >> np.uint64(32)).astype(np.int64)
        a, b = self.index[top].astype(np.int64), self.index[top + 1].astype(np.int64)
        want, end = (low & np.uint64(0xFFFFFFFF)).astype(np.uint32), b.copy()
        n = len(self.low)
        if not n:
            return np.full(len(low), -1, np.int64)
        for _ in range(int((b - a).max(initial=0)).bit_length()):
            mid = (a + b) >> 1
            right = (a < b) & (self.low[np.minimum(mid, n - 1)] < want)
            a = np.where(right, mid + 1, a)
            b = np.where(right, b, np.minimum(b, np.maximum(mid, a)))
        return np.where((a < end) & (self.low[np.minimum(a, n - 1)] == want), a, -1)


class HashFiles:
    """All buckets of a folder; files are mapped when first looked at."""

    def __init__(self, folder: str, bits: int, kinds: list):
        self.folder, self.bits, self.kinds, self.open = folder, bits, kinds, {}
        self.there = None

    def look_up(self, sorted_hashes: np.ndarray) -> list[np.ndarray]:
        """The columns for sorted hashes, 0 where there is no entry."""
        import os

        if self.there is None:
            path = local_path(self.folder)
            self.there = set(os.listdir(path)) if os.path.isdir(path) else set()
        out = [np.zeros(len(sorted_hashes), k) for k in self.kinds]
        bucket = (sorted_hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        low = sorted_hashes & np.uint64((1 << LOW_BITS) - 1)
        edges = np.searchsorted(bucket, np.arange((1 << self.bits) + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            name = f"{b:06d}.hash"
            if name not in self.there:
                continue
            if b not in self.open:
                self.open[b] = HashFile(f"{local_path(self.folder)}/{name}")
            x, y = edges[b], edges[b + 1]
            at = self.open[b].find(low[x:y])
            for o, c in zip(out, self.open[b].columns):
                o[x:y] = np.where(at >= 0, c[np.maximum(at, 0)], 0)
        return out


PAIR = [np.int64]
BLOCK_PAIR = [np.uint32]  # of one task's block
WORD = [np.int64, np.float64, np.float64, np.float64, np.float64]  # count, predecessors, successors seen once, twice, more


def _sum_by(low: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(low, kind="stable")
    low = low[order]
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return low[first], [np.add.reduceat(c[order].astype(np.float64 if c.dtype.kind == "f" else np.int64), first) for c in columns]


def _write_buckets(folder: str, kinds: list, finish):
    """Task over dealt rows sorted by bucket: sums the entries, writes a file a bucket, yields ``finish``'s counts."""
    def write(batches):
        fs, at = open_folder(folder)
        for bucket, low, blobs in _buckets(batches, len(kinds)):
            low, columns = _sum_by(low, [np.frombuffer(b, k) for b, k in zip(blobs, kinds)])
            columns = [np.rint(c).astype(np.int64) for c in columns]
            commit_file(fs, at, f"{bucket:06d}.hash", str(TaskContext.get().taskAttemptId()),
                        HashFile.parts(low, [_narrow(c) for c in columns]))
            yield pa.RecordBatch.from_pydict({"stats": pa.array([finish(columns)], pa.list_(pa.int64()))})

    return write


def _totals(rows: DataFrame, n: int) -> list[int]:
    got = rows.agg(*(F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(n))).first()
    return [int(x or 0) for x in got]


def _discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2, and more, kept within (0, count) where the counts of counts are degenerate."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [k - (k + 1) * y * b / a if a else k * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(x, 0.05 * k), 0.95 * k) for k, x in enumerate(d, 1))])


class Model:
    """Folder names and totals; opened by workers."""

    def __init__(self, folder: str, bits: int, pair_counts: list[int], word_stats: list[int]):
        self.folder, self.bits = folder, bits
        self.pair_discount = _discounts(*pair_counts[1:5])
        self.words, self.tokens, self.kinds_of_pairs, *left = word_stats  # V, N, different bigrams, words by predecessors
        self.left_discount = _discounts(*left[:4])
        many = self.words - left[0] - left[1]
        self.left_weight = (self.left_discount[1] * left[0] + self.left_discount[2] * left[1]
                            + self.left_discount[3] * many) / max(self.kinds_of_pairs, 1)

    def open(self):
        return (HashFiles(f"{self.folder}/pairs", self.bits, PAIR), HashFiles(f"{self.folder}/words", self.bits, WORD))

    def log10(self, files, tokens: np.ndarray, before: np.ndarray):
        """(known, base, model) of each token: whether counted, and the log10 probabilities."""
        pair_files, word_files = files
        uniq, at = np.unique(np.concatenate([tokens, before]), return_inverse=True)
        count, left, once, twice, more = (c[at].astype(float) for c in word_files.look_up(uniq))
        n = len(tokens)
        base = np.log10((count[:n] + 1) / (self.tokens + self.words + 1))
        uniq, at = np.unique(_pairs(before, tokens), return_inverse=True)
        pair = pair_files.look_up(uniq)[0][at].astype(float)
        own, history = slice(0, n), slice(n, 2 * n)
        cut = self.left_discount[np.minimum(left[own], 3).astype(int)]
        lower = np.maximum(left[own] - cut, 0) / max(self.kinds_of_pairs, 1) \
            + (self.left_weight if self.kinds_of_pairs else 1.0) / (self.words + 1)
        d = self.pair_discount
        seen = count[history]
        rest = d[1] * once[history] + d[2] * twice[history] + d[3] * more[history]
        direct = np.maximum(pair - d[np.minimum(pair, 3).astype(int)], 0)
        p = np.where(seen > 0, (direct + rest * lower) / np.maximum(seen, 1), lower)
        return count[:n] > 0, base, np.log10(p)


def fit(docs: DataFrame) -> Model:
    """Count the texts of ``docs`` (text; null is empty) into a model in the shared folder."""
    spark = docs.sparkSession
    folder = scratch(spark, "kneser-ney")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = ready(docs).select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(8, min(24, (max(2 * parts, size // BUCKET_BYTES) - 1).bit_length()))  # buckets grow in number, not in size

    def dealt(rows: DataFrame) -> DataFrame:
        """By bucket, eight or so in a partition; where Spark's own number of partitions does, it may join small ones."""
        spread = rows.repartition(1 << bits >> 3, "bucket") if 1 << bits >> 3 > parts else rows.repartition("bucket")
        return spread.sortWithinPartitions("bucket")

    def count_pairs(batches):
        for tokens, before in _blocks(batches):
            h, c = np.unique(_pairs(before, tokens), return_counts=True)
            yield from _dealt(h, [c.astype(np.uint32)], bits)

    def pair_stats(columns):
        return [len(columns[0]), *(int((columns[0] == k).sum()) for k in (1, 2, 3, 4))]

    pairs = texts.mapInArrow(frugal(count_pairs), "bucket int, hashes binary, c0 binary")
    pair_counts = _totals(dealt(pairs).mapInArrow(
        _write_buckets(f"{folder}/pairs", BLOCK_PAIR, pair_stats), "stats array<long>"), 5)

    def count_words(batches):
        files = HashFiles(f"{folder}/pairs", bits, PAIR)
        for tokens, before in _blocks(batches):
            h, at, times = np.unique(_pairs(before, tokens), return_index=True, return_counts=True)
            c = files.look_up(h)[0].astype(float)
            share = times / np.maximum(c, 1)
            words, which = np.unique(np.concatenate([tokens, before]), return_inverse=True)
            n = len(tokens)
            w, b = which[:n], which[n:]
            # as a history, a token counts as often as it comes; END has no successor and BEGIN is no token
            count = np.bincount(w, minlength=len(words))
            begin = np.searchsorted(words, BEGIN)
            if begin < len(words) and words[begin] == BEGIN:
                count[begin] = int((before == BEGIN).sum())
            columns = [count.astype(np.int64)] + [
                np.bincount(x, share * mine, len(words))
                for x, mine in ((w[at], 1.0), (b[at], c == 1), (b[at], c == 2), (b[at], c > 2))]
            yield from _dealt(words, columns, bits)

    def word_stats(columns):
        count, left = columns[0], columns[1]
        real = left > 0  # not BEGIN
        return [int(real.sum()), int(count[real].sum()), int(left.astype(float).sum()),
                *(int((left == k).sum()) for k in (1, 2, 3, 4))]

    words = texts.mapInArrow(frugal(count_words), "bucket int, hashes binary, " + ", ".join(f"c{k} binary" for k in range(5)))
    stats = _totals(dealt(words).mapInArrow(
        _write_buckets(f"{folder}/words", WORD, word_stats), "stats array<long>"), 7)
    return Model(folder, bits, pair_counts, stats)


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without their text, with n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Scores are log10 probabilities of whole texts, the end included. Null or
    empty text is the end alone. Other columns of ``docs`` stay, but for those
    of the names above.
    """
    spark = docs.sparkSession
    names = [f.split()[0] for f in SCORES.split(", ")]
    docs = docs.drop(*names, "perplexity")
    others = [c for c in docs.columns if c != "text"]
    docs = ready(docs).select(*others, "text")
    shared = spark.sparkContext.broadcast(model)
    schema = spark.createDataFrame([], SCORES).schema
    for f in reversed([docs.schema[c] for c in others]):
        schema.fields.insert(0, f)
        schema.names.insert(0, f.name)

    def run(batches):
        m = shared.value
        files = m.open()
        for batch in batches:
            out = [[], [], [], []]
            for _, tokens, before, bounds in _tokens(batch.column(len(others))):
                known, base, logs = m.log10(files, tokens, before)
                for part, x in zip(out, (np.ones(len(tokens)), known, base, logs)):
                    part.append(np.add.reduceat(x.astype(float), bounds[:-1]))
            n, known, base, logs = (np.concatenate(x) if x else np.zeros(0) for x in out)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)),
                 pa.array(np.full(len(n), m.tokens, np.int64)), pa.array(base), pa.array(logs)],
                [*others, *names])

    return docs.mapInArrow(frugal(run), schema).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def fit_and_score(docs: DataFrame, training: Column) -> DataFrame:
    """Learn from the rows where ``training`` holds, and score all rows."""
    return score(docs, fit(docs.where(training)))
