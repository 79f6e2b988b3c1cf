"""N-gram Jaccard join with signature trees.

Two documents link when the Jaccard similarity of their word shingles reaches a
threshold. Documents with equal shingle sets are one class. Each class is
posted under the smallest shingles of its set (prefix filter: linked sets share
one of them), in an order that puts common shingles last, by their frequency;
the order only affects speed. Classes posted under a shingle form a run.

Round 1 compares each class of a run with its smallest class, round 2 with the
class that shares most shingles with others (an original among edited copies);
this joins most groups of copies at a linear number of comparisons. Round 3
finds all further pairs between different components: a signature tree over each run (nodes hold
OR-combined bitmaps, size ranges and component ranges) is traversed against
itself, pruning node pairs by their largest possible overlap; long runs are cut
into blocks that are traversed pair by pair. A run of SHORT classes or fewer is
a single leaf: its pairs are listed once for all runs before the same test, so
that signatures travel once a pair and not once a posting. All pairs left are
compared exactly, so no link between two components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import frugal, give_back, ready, saved
from .textops import BLANK, byte_values, gram_hashes, mix, text_slices, word_hashes

GRAM_BITS = 48  # shingles are 48-bit hashes
COUNT_BLOCK = 1 << 20  # shingles counted together when looking for common ones
COMMON = 1 << 20  # shingles that are put last, at most, at every size of the input
SALTED = 4096  # a shingle that is counted so often is posted in parts
POST_BLOCK = 1 << 19  # postings that a task packs together
RUN_BLOCK = 2048  # rows of a run that are traversed together
SHORT = 8  # a run of so few classes is a leaf of its own
LEAF = 32
FAN = 8


def _sets(column, n: int):
    """(row, sorted distinct shingles) of each text with a word, in row order."""
    values = byte_values(~BLANK)
    for i, j, data, offsets in text_slices(column):
        words, bounds = word_hashes(data, offsets, values)
        grams = gram_hashes(words, n) >> np.uint64(64 - GRAM_BITS)
        for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if b - a >= n:
                yield i + r, np.unique(grams[a:b - n + 1])
            elif b > a:
                yield i + r, gram_hashes(words[a:b], b - a) >> np.uint64(64 - GRAM_BITS)


def _set_key(grams: np.ndarray) -> int:
    h = mix(np.array([np.add.reduce(mix(grams + np.uint64(1))) + np.uint64(len(grams))], np.uint64))
    return int(h.view(np.int64)[0])


def _signature(grams: np.ndarray) -> bytes:
    """Bitmap of the shingles: eight times as many bits as shingles up to 4096 bits, else twice as many.

    Rounded up to a power of two (64 to 16384).
    """
    up = 1 << (len(grams) - 1).bit_length()
    bits = max(64, min(4096, 8 * up), min(16384, 2 * up))
    flags = np.zeros(bits, np.uint8)
    flags[(grams % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _sketch(grams: np.ndarray) -> int:
    """Four bits of the smallest shingle in each eighth of the range."""
    edges = np.arange(8, dtype=np.uint64) << np.uint64(GRAM_BITS - 3)
    at = np.minimum(np.searchsorted(grams, edges), len(grams) - 1)
    nibbles = mix(grams[at]) & np.uint64(15)
    return int((nibbles << (np.arange(8, dtype=np.uint64) * np.uint64(4))).sum())


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether half of the sketches' parts agree (used in rounds 1 and 2 only)."""
    x = a ^ b
    equal = sum(((x >> np.uint32(4 * k)) & np.uint32(15)) == 0 for k in range(8))
    return equal >= 4


def _need(n, percent: int):
    """Smallest overlap of a set of n shingles with a set that it links to."""
    return -(-percent * n // 100)


DOC = "kind int, doc_id long, n long, key long, first boolean, signature binary, gram long, count long"


def _scan(n: int):
    """Task over (doc_id, text): a row a document, and shingles that are common in a block."""
    def scan(batches):
        seen: set[int] = set()
        block, size = [], 0

        def common():
            grams, counts = np.unique(np.concatenate(block), return_counts=True)
            often = counts >= 2
            m = int(often.sum())
            return pa.RecordBatch.from_arrays(
                [pa.array([1] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                 pa.nulls(m, pa.bool_()), pa.nulls(m, pa.binary()), pa.array(grams[often].astype(np.int64)),
                 pa.array(counts[often].astype(np.int64))], names)

        names = [f.split()[0] for f in DOC.split(", ")]
        for batch in batches:
            ids, rows = batch.column(0), len(batch)
            found = [(0, None, None, None)] * rows
            valid = ids.is_valid().to_pylist()
            for r, grams in _sets(batch.column(1), n):
                key = _set_key(grams) if valid[r] else None
                first = valid[r] and key not in seen
                found[r] = (len(grams), key, first, _signature(grams) if first else None)
                if first:
                    seen.add(key)
                    block.append(grams)
                    size += len(grams)
                    if size >= COUNT_BLOCK:
                        yield common()
                        block, size = [], 0
                        give_back()
            columns = list(zip(*found)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * rows, pa.int32()), ids.cast(pa.int64())]
                + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))]
                + [pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())], names)
        if block:
            yield common()

    return scan


def _common(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent shingles (COMMON at most), sorted, their order by count, and those to be posted in parts.

    The least count that is listed is the one that keeps the list in bounds.
    """
    step = F.when(F.col("c") < SALTED, F.col("c")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("c"))).cast("long"))
    spread = counted.groupBy(step.alias("c")).agg(F.count(F.lit(1)).alias("m")).collect()  # some 4100 rows at most
    least, size = 1 << 62, 0
    for r in sorted(spread, key=lambda r: -r["c"]):
        size += r["m"]
        if size > COMMON:
            break
        least = r["c"]
    listed = counted.where(F.col("c") >= least).toArrow()
    grams, counts = listed.column("gram").to_numpy().astype(np.uint64), listed.column("c").to_numpy()
    by_gram = np.argsort(grams)
    grams, counts = grams[by_gram], counts[by_gram]
    rank = np.empty(len(grams), np.int32)
    rank[np.lexsort((grams, counts))] = np.arange(len(grams), dtype=np.int32)
    return grams, rank, grams[counts >= SALTED]


def _prefixes(n: int, percent: int, hot, buckets: int, hot_parts: int):
    """Task over (doc_id, text): postings (shingle, class, sketch) packed by bucket of the shingle."""
    def post(batches):
        common, rank, salted = hot.value
        seen: set[int] = set()
        grams_, keys_, sketches_, size = [], [], [], 0

        def packed():
            g, k = np.concatenate(grams_), np.repeat(np.array(keys_, np.int64), list(map(len, grams_)))
            s = np.repeat(np.array(sketches_, np.uint32), list(map(len, grams_)))
            salt = np.zeros(len(g), np.uint64)
            if len(salted):  # a very common shingle is posted in parts, another division for each
                is_hot = salted[np.minimum(np.searchsorted(salted, g), len(salted) - 1)] == g
                salt[is_hot] = mix(k[is_hot].view(np.uint64) ^ (g[is_hot] << np.uint64(16))) % np.uint64(hot_parts) + np.uint64(1)
            bucket = (mix(g * np.uint64(31) + salt) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            g6 = g[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            k, s, edges = k[order], s[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)):
                x, y = edges[b], edges[b + 1]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([b], pa.int32()), "grams": pa.array([g6[x:y].tobytes()], pa.binary()),
                    "keys": pa.array([k[x:y].tobytes()], pa.binary()), "sketches": pa.array([s[x:y].tobytes()], pa.binary())})

        for batch in batches:
            valid = batch.column(0).is_valid().to_pylist()
            for r, grams in _sets(batch.column(1), n):
                if not valid[r]:
                    continue
                key = _set_key(grams)
                if key in seen:
                    continue
                seen.add(key)
                size_ = len(grams) - _need(len(grams), percent) + 1
                sketch = _sketch(grams)
                if len(common):
                    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
                    listed = common[at] == grams
                    last = grams[listed][np.argsort(rank[at[listed]])]
                    grams = np.concatenate([grams[~listed], last])
                grams_.append(grams[:size_])
                keys_.append(key)
                sketches_.append(sketch)
                size += size_
                if size >= POST_BLOCK:
                    yield from packed()
                    grams_, keys_, sketches_, size = [], [], [], 0
                    give_back()
        if size:
            yield from packed()

    return post


def _first_pairs(hot):
    """Task over rows sorted by bucket: in each run, pairs with its smallest class (kind 0) and the postings (kind 1).

    One bucket is held at a time. Postings that are alone under their shingle go, but for very common
    shingles: those come in parts, so others may be elsewhere.
    """
    def one(parts):
        raw = np.frombuffer(b"".join(parts[0]), np.uint8).reshape(-1, 6)
        g = np.zeros((len(raw), 8), np.uint8)
        g[:, :6] = raw
        g = g.view("<u8").ravel()
        k, s = np.frombuffer(b"".join(parts[1]), np.int64), np.frombuffer(b"".join(parts[2]), np.uint32)
        order = np.lexsort((k, g))
        g, k, s = g[order], k[order], s[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
        g, k, s = g[new], k[new], s[new]
        begins = np.ones(len(g), bool)
        begins[1:] = g[1:] != g[:-1]
        first = np.flatnonzero(begins)
        lengths = np.diff(np.append(first, len(g)))
        head = np.repeat(first, lengths)
        rest = ~begins & _alike(s, s[head])
        pairs = np.unique(np.stack([k[head][rest], k[rest]], 1), axis=0)
        shared = np.repeat(lengths > 1, lengths)
        salted = hot.value[2]
        if len(salted):
            shared |= salted[np.minimum(np.searchsorted(salted, g), len(salted) - 1)] == g
        none = np.zeros(len(pairs), np.uint32)
        for kind, a, b, c in ((0, pairs[:, 0], pairs[:, 1], none), (1, g[shared].astype(np.int64), k[shared], s[shared])):
            for x in range(0, len(a), 100_000):
                part = a[x:x + 100_000]
                yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(part), pa.int32()),
                                                  "a": pa.array(part), "b": pa.array(b[x:x + 100_000]),
                                                  "sketch": pa.array(c[x:x + 100_000].astype(np.int64))})

    def run(batches):
        bucket, parts = None, [[], [], []]
        for batch in batches:
            for b, *blobs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "grams", "keys", "sketches"))):
                if b != bucket and parts[0]:
                    yield from one(parts)
                    parts = [[], [], []]
                bucket = b
                for part, blob in zip(parts, blobs):
                    part.append(blob)
        if parts[0]:
            yield from one(parts)

    return run


def _needed_docs(ids: DataFrame) -> np.ndarray:
    """Bitmap (2**20 bits, at every size) of hashes of the doc_ids; it spares most texts a shuffle."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    rows = ids.select(bit.alias("h")).groupBy(F.shiftright("h", 5).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 31 as int))")).alias("v")).collect()
    out = np.zeros(1 << 15, np.int64)
    for r in rows:
        out[r["w"]] = r["v"]
    return out


def _verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough, by exact comparison.

    Each pair becomes a row for b in the unit of a; a itself comes first in its
    unit, and tasks keep that one set only. A class with many pairs has several units.
    """
    spark = docs.sparkSession
    parts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).select(
        "a", (1 + F.floor(F.col("m") / 256)).cast("int").alias("parts"))
    rows = pairs.join(saved(parts, "pair-counts"), "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("key"), F.lit(1).alias("role"))
    heads = rows.select("a", "part").distinct().select("a", "part", F.col("a").alias("key"), F.lit(0).alias("role"))
    rows = saved(rows.unionByName(heads).join(reps, "key"), "pair-rows")
    bits = spark.sparkContext.broadcast(_needed_docs(rows.select("doc_id").distinct()))
    flagged = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("h"))

    def sets(batches):
        needed = bits.value
        for batch in batches:
            h = batch.column(2).to_numpy()
            rows_ = np.flatnonzero((needed[h >> 5] >> (h & 31)) & 1)
            if not len(rows_):
                continue
            part = batch.take(pa.array(rows_))
            found = [(r, _set_key(g), g.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                     for r, g in _sets(part.column(1), n)]
            at = pa.array([r for r, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(0).take(at).cast(pa.int64()), "key": pa.array([k for _, k, _ in found], pa.int64()),
                "grams": pa.array([x for _, _, x in found], pa.binary())})

    def compare(batches):
        head, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, part, role, key, grams in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "role", "key", "grams"))):
                full = np.zeros((len(grams) // 6, 8), np.uint8)
                full[:, :6] = np.frombuffer(grams, np.uint8).reshape(-1, 6)
                full = full.view("<u8").ravel()
                if role == 0:
                    head, own = (a, part), full
                elif head == (a, part):
                    at = np.minimum(np.searchsorted(own, full), len(own) - 1)
                    both = int((own[at] == full).sum())
                    if 100 * both >= percent * (len(own) + len(full) - both):
                        out.append((a, key))
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()),
                                              "b": pa.array([b for _, b in out], pa.int64())})

    with_sets = rows.join(flagged.where("doc_id is not null").mapInArrow(frugal(sets), "doc_id long, key long, grams binary"),
                          ["doc_id", "key"])
    units = with_sets.select("a", "part", "role", "key", "grams").repartition("a", "part").sortWithinPartitions(
        "a", "part", "role")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # rows hold whole sets here
    try:
        return saved(units.mapInArrow(frugal(compare), "a long, b long"), "links")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of ``words`` 64-bit words from wider ones."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), 1)


class SignatureTree:
    """Rows in order of size; nodes of FAN children over leaves of LEAF rows."""

    def __init__(self, sizes, comps, bits):
        self.levels = [(sizes, sizes, comps, comps, bits, np.bitwise_count(bits).sum(1, dtype=np.int64))]
        step = LEAF
        while len(self.levels[-1][0]) > 1:
            low, high, cmin, cmax, ors, ones = self.levels[-1]
            at = np.arange(0, len(low), step)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(cmin, at),
                                np.maximum.reduceat(cmax, at), np.bitwise_or.reduceat(ors, at), np.minimum.reduceat(ones, at)))
            step = FAN

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fan = LEAF if level == 1 else FAN
        first = node * fan
        return first, np.minimum(first + fan, len(self.levels[level - 1][0])) - first


def _may_link(x, y, i, j, percent):
    """Whether nodes i and j may hold a pair of different components with enough overlap."""
    low_a, high_a, cmin_a, cmax_a, or_a, ones_a = (v[i] for v in x)
    low_b, high_b, cmin_b, cmax_b, or_b, ones_b = (v[j] for v in y)
    ok = (percent * low_a <= 100 * high_b) & (percent * low_b <= 100 * high_a)
    ok &= ~((cmin_a == cmax_a) & (cmin_b == cmax_b) & (cmin_a == cmin_b))
    both = np.bitwise_count(or_a & or_b).sum(1, dtype=np.int64)
    # shingles of a row on bits that the other side lacks are not shared
    most = np.minimum(high_a - np.maximum(0, ones_a - both), high_b - np.maximum(0, ones_b - both))
    # 100 I >= percent (A + B - I)
    return ok & ((100 + percent) * most >= percent * (low_a + low_b))


def traverse(a: SignatureTree, b: SignatureTree, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two trees (or of one, each pair once) that may link: dual traversal, level by level."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        keep = []
        for k in range(0, len(i), 1 << 15):
            keep.append(_may_link(a.levels[la], b.levels[lb], i[k:k + (1 << 15)], j[k:k + (1 << 15)], percent))
        ok = np.concatenate(keep) if keep else np.zeros(0, bool)
        i, j = i[ok], j[ok]
        if la == lb == 0 or not len(i):
            break
        if la >= lb:
            first, count = a.children(la, i)
            i, j = np.repeat(first, count) + _within(count), np.repeat(j, count)
            la -= 1
            if same and lb > la:  # both sides step down together
                first, count = b.children(lb, j)
                i, j = np.repeat(i, count), np.repeat(first, count) + _within(count)
                lb -= 1
                half = i <= j
                i, j = i[half], j[half]
        else:
            first, count = b.children(lb, j)
            i, j = np.repeat(i, count), np.repeat(first, count) + _within(count)
            lb -= 1
    if same:
        i, j = i[i < j], j[i < j]
    return i, j


def _within(count: np.ndarray) -> np.ndarray:
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count)


def _traverse_run(keys, sizes, comps, blobs, side, percent: int) -> set[tuple[int, int]]:
    """Pairs of classes of a run (one block, or block against block) that may link.

    Signatures of one width make one tree; trees of unequal widths meet at the
    narrower one. Sets that link differ in width by a factor of two at most
    (none, where both have more than 8192 shingles).
    """
    trees, out = {}, set()
    widths = np.array([len(x) // 8 for x in blobs])
    for s in np.unique(side):
        for w in np.unique(widths[side == s]):
            rows = np.flatnonzero((side == s) & (widths == w))
            rows = rows[np.argsort(sizes[rows], kind="stable")]
            bits = np.frombuffer(b"".join(blobs[r] for r in rows), np.uint64).reshape(len(rows), w)
            trees[int(s), int(w)] = (rows, bits)
    both_sides = len(np.unique(side)) == 2
    built = {}

    def tree(s, w, at):
        if (s, w, at) not in built:
            rows, bits = trees[s, w]
            built[s, w, at] = SignatureTree(sizes[rows], comps[rows], _fold(bits, at))
        return built[s, w, at]

    for (s, w) in trees:
        for (t, v) in trees:
            if max(w, v) > 2 * min(w, v) or (both_sides and (s, t) != (0, 1)) or (not both_sides and w > v):
                continue
            at = min(w, v)
            i, j = traverse(tree(s, w, at), tree(t, v, at), percent, (s, w) == (t, v))
            for x, y in zip(keys[trees[s, w][0][i]].tolist(), keys[trees[t, v][0][j]].tolist()):
                if x != y:
                    out.add((min(x, y), max(x, y)))
    return out


def _further_pairs(percent: int):
    """Task over rows sorted by unit (shingle, i, j): pairs from the unit's signature trees."""
    def unit_pairs(table: pa.Table) -> set:
        keys, sizes, comps = (table.column(c).to_numpy() for c in ("key", "n", "comp"))
        if table.column("i")[0] == table.column("j")[0]:
            side = np.zeros(len(keys), np.int64)
        else:
            side = (table.column("block").to_numpy() != table.column("i")[0].as_py()).astype(np.int64)
            if side.min() == side.max():
                return set()
        return _traverse_run(keys, sizes, comps, table.column("signature").to_pylist(), side, percent)

    def run(batches):
        rest: list[pa.RecordBatch] = []
        done: set[tuple[int, int]] = set()

        def ready():
            pairs = list(done)
            done.clear()
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in pairs], pa.int64()),
                                               "b": pa.array([b for _, b in pairs], pa.int64())})

        def units(table: pa.Table):
            g, i, j = (table.column(c).to_numpy() for c in ("gram", "i", "j"))
            new = np.flatnonzero((g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            edges = [0, *new.tolist(), len(g)]
            return [(a, b) for a, b in zip(edges, edges[1:])]

        for batch in batches:
            if not len(batch):
                continue
            rest.append(batch)
            table = pa.Table.from_batches(rest)
            spans = units(table)
            for a, b in spans[:-1]:  # the last unit may go on in the next batch
                if b - a > 1:
                    done |= unit_pairs(table.slice(a, b - a).combine_chunks())
            rest = table.slice(spans[-1][0]).combine_chunks().to_batches()
            if len(done) > 50_000:
                yield ready()
        if rest:
            done |= unit_pairs(pa.Table.from_batches(rest).combine_chunks())
        yield ready()

    return run


def _leaf_pairs(runs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b, with sizes) of classes that share a run, differ in component and may link by their sizes.

    ``runs``: postings of runs of SHORT rows at most.
    """
    rows = runs.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("key", "comp", "n"))).alias("run"))
    one = rows.select("run", F.posexplode("run").alias("at", "x"))
    two = one.select("x", F.explode(F.expr("slice(run, at + 2, size(run))")).alias("y"))
    near = (percent * F.col("x.n") <= 100 * F.col("y.n")) & (percent * F.col("y.n") <= 100 * F.col("x.n"))
    return two.where((F.col("x.comp") != F.col("y.comp")) & near).select(
        F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).distinct()


def _leaf_test(percent: int):
    """Task over (a, b, n_a, n_b, sig_a, sig_b): the pairs that may link."""
    def run(batches):
        for batch in batches:
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            blobs = batch.column("sig_a").to_pylist(), batch.column("sig_b").to_pylist()
            widths = np.array([[len(x) // 8 for x in side] for side in blobs]).reshape(2, -1)
            low = widths.min(0) if len(batch) else np.zeros(0, np.int64)
            keep = []
            for w in np.unique(low):
                rows = np.flatnonzero((low == w) & (widths.max(0) <= 2 * w))
                if not len(rows):
                    continue
                sides = []
                for n, side, comp in ((n_a, blobs[0], 0), (n_b, blobs[1], 1)):
                    bits = np.stack([_fold(np.frombuffer(side[r], np.uint64)[None], w)[0] for r in rows])
                    comps = np.full(len(rows), comp)
                    sides.append((n[rows], n[rows], comps, comps, bits, np.bitwise_count(bits).sum(1, dtype=np.int64)))
                at = np.arange(len(rows))
                keep.append(rows[_may_link(*sides, at, at, percent)])
            yield batch.select(["a", "b"]).take(pa.array(np.concatenate([np.zeros(0, np.int64), *keep])))

    return run


def _with_components(posted: DataFrame, comps: DataFrame) -> DataFrame:
    return saved(posted.join(comps.select(F.col("node").alias("key"), "component"), "key", "left").select(
        "gram", "key", "sketch", F.coalesce("component", "key").alias("comp")), "postings")


def _mixed(posted: DataFrame) -> DataFrame:
    """Runs of more than one component, and their rows."""
    return posted.groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high"),
                                      F.count(F.lit(1)).alias("m")).where("low != high")


def _hub_pairs(posted: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class with the run's class that has most shared shingles, if their sketches are alike."""
    posted = _with_components(posted, comps)
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    rated = posted.join(_mixed(posted).select("gram"), "gram").join(shared, "key")
    rated = saved(rated.select("gram", F.struct("m", "key", "comp", "sketch").alias("row")), "rated-postings")
    hubs = saved(rated.groupBy("gram").agg(F.max("row").alias("hub")), "hubs")
    other = F.expr("row.sketch ^ hub.sketch")
    alike = sum(F.when(F.shiftright(other, 4 * k).bitwiseAND(F.lit(15)) == 0, 1).otherwise(0) for k in range(8))
    return rated.join(hubs, "gram").where((F.col("row.comp") != F.col("hub.comp")) & (alike >= 4)).select(
        F.least("row.key", "hub.key").alias("a"), F.greatest("row.key", "hub.key").alias("b")).distinct()


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Components of the documents under links of shingle similarity >= percent / 100.

    ``docs``: doc_id, text; other columns are not looked at. A-Z count as a-z;
    words are runs of non-blank bytes; a document's set is its distinct n-word
    shingles, or its whole word sequence if shorter. Returns doc_id, n_shingles,
    component_id (smallest doc_id reachable) for every row. Null or empty texts
    have an empty set and link with nothing; so do rows with null doc_id (their
    component is null). Repeated rows are given back as often as they come.
    """
    spark = docs.sparkSession
    docs = ready(docs).select(F.col("doc_id").cast("long"), "text")
    scanned = saved(docs.mapInArrow(frugal(_scan(n)), DOC), "sets")
    rows = scanned.where("kind = 0").select("doc_id", "n", "key")
    classes = scanned.where("kind = 0 and first")
    sized = saved(classes.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n")), "classes")
    reps = sized.select("key", "doc_id")
    total = reps.count()
    hot = spark.sparkContext.broadcast(_common(saved(
        scanned.where("kind = 1").groupBy("gram").agg(F.sum("count").alias("c")).where("c > 2"), "common")))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = docs.mapInArrow(frugal(_prefixes(n, percent, hot, buckets, max(16, total // 20_000))), "bucket int, grams binary, keys binary, sketches binary")
    found = saved(postings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(frugal(_first_pairs(hot)), "kind int, a long, b long, sketch long"), "runs")

    pairs = saved(found.where("kind = 0").select("a", "b").distinct(), "pairs")
    links = _verified(docs, pairs, reps, n, percent)
    comps = components(links)

    posted = found.where("kind = 1").select(F.col("a").alias("gram"), F.col("b").alias("key"), "sketch")
    second = _hub_pairs(posted, comps).join(pairs, ["a", "b"], "left_anti")
    links = saved(links.unionByName(_verified(docs, saved(second, "hub-pairs"), reps, n, percent)), "links")
    comps = components(links)

    nodes = sized.join(comps.select(F.col("node").alias("key"), "component"), "key", "left").select(
        "key", "n", F.coalesce("component", "key").alias("comp"))
    posted = saved(posted.join(nodes, "key").select("gram", "key", "n", "comp"), "postings")
    mixed = _mixed(posted).select("gram", "m", F.ceil(F.col("m") / RUN_BLOCK).cast("int").alias("blocks"))
    live = saved(posted.join(saved(mixed, "mixed-runs"), "gram"), "live-postings")
    info = classes.join(reps, ["key", "doc_id"]).join(live.select("key").distinct(), "key", "left_semi")
    info = saved(info.dropDuplicates(["key"]).select("key", "signature"), "signatures")
    short = saved(_leaf_pairs(live.where(F.col("m") <= SHORT), percent), "leaf-pairs")
    for end in ("a", "b"):
        short = short.join(info.select(F.col("key").alias(end), F.col("signature").alias(f"sig_{end}")), end)
    short = short.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(_leaf_test(percent), "a long, b long")
    live = live.where(F.col("m") > SHORT).join(info, "key")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    units = live.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "gram", F.least("block", "other").cast("int").alias("i"), F.greatest("block", "other").cast("int").alias("j"),
        "block", "key", "n", "comp", "signature")
    more = units.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j").mapInArrow(
        frugal(_further_pairs(percent)), "a long, b long")
    more = saved(saved(more, "further-pairs").unionByName(short).distinct(), "pairs")
    if not more.isEmpty():
        extra = _verified(docs, more, reps, n, percent)
        comps = components(links.unionByName(extra))

    named = rows.join(comps.select(F.col("node").alias("key"), "component"), "key", "left").select(
        "doc_id", "n", F.coalesce("component", "key").alias("comp"))
    named = saved(named, "named")
    smallest = saved(named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("low")), "components")
    return named.join(smallest, "comp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))
