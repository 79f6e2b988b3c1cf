"""Benchmark decontamination: a BM25 index of test items, queried by block-max WAND.

The items are the index, the training passages the queries. Document frequencies
and lengths are counted over all items by Spark; each item's weights are then
divided by the item's own full score, so one threshold serves all items. The
index is cut into parts of bounded size, each built in a task and written to
the shared folder; what a part holds does not depend on the other items in it.

A passage first meets the term maxima of groups of items: a passage and a
group whose maxima add up to less than the threshold go no further (most do).
For the rest, block-max WAND runs through the group's postings: lists are kept
by their next item, the pivot is the first item at which the term maxima reach
the threshold, block maxima at the pivot either prove the whole block too weak
(then all lists skip it) or let the pivot be scored. All items that reach the
threshold are retrieved, and verified by the overlap of question and answer.
"""

from __future__ import annotations

import io
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import commit_file, frugal, open_folder, ready, saved, scratch
from .textops import ALNUM, byte_values, gram_hashes, text_slices, utf8, word_hashes

K1, B = 1.2, 0.75
BLOCK_ITEMS = 8  # items under one block maximum
GROUPS = 32  # groups of a part's items whose term maxima are summed first, at most
PART_TERMS = 1 << 18  # postings of a part, about
HELD_BYTES = 128 << 20  # of index parts that a worker keeps
SCORE_SHARE = 0.5  # least BM25 score, as a share of the item's own
OVERLAP = 0.8  # least overlap of the question's shingles, and of the answer's words; see `enough`
SHINGLE, SHORT_SHINGLE = 5, 3  # words; the shorter ones for questions of fewer than SHORT_QUESTION words
SHORT_QUESTION = 64
_VALUES = byte_values(ALNUM)


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last line, else its last sentence, is the answer; the rest is the question."""
    text = text.strip()
    for pattern in (r"\n(?=[^\n]*\S[^\n]*$)", r"(?<=[.?!])\s+(?=[^.?!]+[.?!]*$)"):
        if m := re.search(pattern, text):
            question, answer = text[:m.start()], text[m.end():]
            if re.search(r"\w", question) and re.search(r"\w", answer):
                return question, answer
    return text, ""


def _hashes(texts: list[str]) -> list[np.ndarray]:
    data, offsets = utf8(pa.array(texts, pa.string()))
    words, bounds = word_hashes(data, offsets, _VALUES)
    return [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _shingle_size(words: int) -> int:
    """Words of a shingle of a question: short questions have short ones, so that one changed word leaves most."""
    return max(1, min(words, SHINGLE if words >= SHORT_QUESTION else SHORT_SHINGLE))


def enough(parts: int, broken: int) -> float:
    """Least share of ``parts`` shingles or words that must be found: OVERLAP, or less where one changed word breaks
    ``broken`` of few parts; never under one half, and all but nothing for fewer than two such breaks."""
    return OVERLAP if parts < 2 * broken else min(OVERLAP, max(0.5, 1 - broken / parts))


# ---- the index -----------------------------------------------------------------------

@dataclass
class ItemIndex:
    """Postings of some items of one length class; a passage's window is twice ``stride`` words.

    ``terms``: sorted hashes; term k's postings are ``post_at[k]`` to ``post_at[k + 1]`` (items ascending, weights),
    its blocks ``block_at[k]`` to ``block_at[k + 1]`` (block number ascending, largest weight).
    ``group_max``: largest weight by term and group of ``group_items`` items, and ``group_at``: where the group's
    postings of the term begin. Question shingles and
    answer words of item k are ``q_at[k]`` to ``q_at[k + 1]``, and so on; ``q_size`` is its shingle length.
    """

    stride: np.ndarray
    item_ids: np.ndarray
    terms: np.ndarray
    post_at: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    block_at: np.ndarray
    blocks: np.ndarray
    block_max: np.ndarray
    group_items: np.ndarray
    group_max: np.ndarray
    group_at: np.ndarray
    questions: np.ndarray
    q_at: np.ndarray
    q_size: np.ndarray
    answers: np.ndarray
    a_at: np.ndarray
    maybe: np.ndarray  # 65536 flags by the low bits of a term's hash


def make_index(stride: int, items: list[tuple[int, str, np.ndarray, np.ndarray]]) -> ItemIndex:
    """The index of (item_id, text, term hashes, weights) rows."""
    n = len(items)
    term = np.concatenate([t for _, _, t, _ in items])
    weight = np.concatenate([w for *_, w in items])
    item = np.repeat(np.arange(n), [len(t) for _, _, t, _ in items])
    terms, which = np.unique(term, return_inverse=True)
    order = np.lexsort((item, which))
    which, item, weight = which[order], item[order], weight[order]
    post_at = np.searchsorted(which, np.arange(len(terms) + 1))
    block = item // BLOCK_ITEMS
    first = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (block[1:] != block[:-1])]))
    size = max(BLOCK_ITEMS, -(-n // GROUPS))
    groups = np.zeros((len(terms), -(-n // size)), np.float32)
    np.maximum.at(groups, (which, item // size), weight.astype(np.float32))
    groups *= np.float32(1 + 1e-6)  # upper bounds, whatever the rounding
    n_groups = groups.shape[1]
    group_at = np.searchsorted(which * np.int64(n_groups) + item // size,
                               np.arange(len(terms))[:, None] * n_groups + np.arange(n_groups + 1))
    parts = [question_and_answer(t) for _, t, *_ in items]
    questions = _hashes([q for q, _ in parts])
    sizes = [_shingle_size(len(q)) for q in questions]
    shingles = [np.unique(gram_hashes(q, k)) if len(q) else q for q, k in zip(questions, sizes)]
    answers = [np.unique(a) for a in _hashes([a for _, a in parts])]
    ends = lambda xs: np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int64)
    maybe = np.zeros(65536, bool)
    maybe[(terms & np.uint64(65535)).astype(np.int64)] = True
    return ItemIndex(np.int64(stride), np.array([i for i, *_ in items], np.int64), terms, post_at, item, weight,
                     np.searchsorted(which[first], np.arange(len(terms) + 1)),
                     block[first], np.maximum.reduceat(weight, first), np.int64(size), groups, group_at,
                     np.concatenate([np.zeros(0, np.uint64), *shingles]), ends(shingles), np.array(sizes, np.int64),
                     np.concatenate([np.zeros(0, np.uint64), *answers]), ends(answers), maybe)


def build_indexes(benchmark: DataFrame) -> tuple[str, list[tuple[str, int]]]:
    """Write the index parts of all items; returns their folder and (file, bytes) of each.

    An item without an id or a word has no place; equal rows count once. Frequencies, the number of items and
    their mean length are those of all items. Items are grouped by length class (a power of two of words, 64 at
    least) and dealt to parts by a hash of their row.
    """
    spark = benchmark.sparkSession
    rows = ready(benchmark).select(F.col("item_id").cast("long"), "text").where(
        "item_id is not null and text is not null").distinct().select("*", F.xxhash64("item_id", "text").alias("row"))

    def count(batches):
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(1)):
                words, bounds = word_hashes(data, offsets, _VALUES)
                pairs = [np.unique(words[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:])]
                sizes = [len(t) for t, _ in pairs]
                at = pa.array(np.repeat(np.arange(i, j), sizes))
                flat = lambda k, kind: np.concatenate([np.zeros(0, kind), *(p[k] for p in pairs)])
                yield pa.RecordBatch.from_pydict({
                    "row": batch.column(2).take(at), "term": flat(0, np.uint64).view(np.int64),
                    "tf": flat(1, np.int64), "length": np.repeat(np.diff(bounds), sizes)})

    rows = saved(rows, "items")
    posts = saved(rows.mapInArrow(count, "row long, term long, tf long, length long"), "item-terms")
    total = posts.groupBy("row").agg(F.first("length").alias("length")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    folder = scratch(spark, "item-index")
    if not total["n"]:
        return folder, []
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.lit(total["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(total["mean"])))
    weighed = posts.join(df, "term").groupBy("row").agg(
        F.first("length").alias("length"), F.sum(idf * part).alias("full"),
        F.sort_array(F.collect_list(F.struct("term", (idf * part).alias("w")))).alias("terms"))
    stride = F.greatest(F.lit(64), F.pow(F.lit(2), F.ceil(F.log2("length"))).cast("long"))
    items = saved(weighed.join(rows, "row").withColumn("stride", stride), "weighed-items")
    sizes = items.groupBy("stride").agg(F.ceil(F.sum(F.size("terms")) / PART_TERMS).alias("parts"))  # a row a length class
    dealt = items.join(F.broadcast(sizes), "stride").withColumn("part", F.pmod("row", "parts"))

    def build(batches):
        fs, at = open_folder(folder)

        def write(key, held):
            index = make_index(key[0], held)
            out = io.BytesIO()
            np.savez(out, **asdict(index))
            name = f"items-{key[0]:08d}-{key[1]:06d}.npz"
            size = commit_file(fs, at, name, str(TaskContext.get().taskAttemptId()), [out.getvalue()])
            return pa.RecordBatch.from_pydict({"file": [name], "bytes": [size]})

        key, held = None, []
        for batch in batches:
            for *own, item_id, text, full, hashes, w in zip(*(batch.column(k).to_pylist() for k in range(5)),
                                                            batch.column(5).to_pylist(), batch.column(6).to_pylist()):
                if tuple(own) != key and held:
                    yield write(key, held)
                    held = []
                key = tuple(own)
                held.append((item_id, text, np.array(hashes, np.int64).view(np.uint64), np.array(w) / full))
        if held:
            yield write(key, held)

    ordered = dealt.select("stride", "part", "item_id", "text", "full", F.col("terms.term").alias("hashes"),
                           F.col("terms.w").alias("w")).repartition("stride", "part").sortWithinPartitions(
        "stride", "part", "item_id", "text")
    files = ordered.mapInArrow(frugal(build), "file string, bytes long")
    return folder, sorted((r["file"], r["bytes"]) for r in saved(files, "item-files").collect())


class Parts:
    """A worker's view of the index parts; it keeps the last ones read, HELD_BYTES of them at most."""

    def __init__(self, folder: str, files: list[tuple[str, int]]):
        self.folder, self.files, self.held = folder, files, {}

    def __iter__(self) -> Iterator[ItemIndex]:
        fs, at = open_folder(self.folder)
        for name, size in self.files:
            if name not in self.held:
                while self.held and sum(s for s, _ in self.held.values()) + size > HELD_BYTES:
                    self.held.pop(next(iter(self.held)))
                with fs.open_input_file(f"{at}/{name}") as f, np.load(io.BytesIO(f.read())) as raw:
                    self.held[name] = size, ItemIndex(**{k: raw[k] for k in raw.files})
            yield self.held[name][1]


# ---- queries -------------------------------------------------------------------------

def block_max_wand(index: ItemIndex, terms: np.ndarray, group: int) -> list[tuple[int, float]]:
    """(item, score) of the group's items whose weights of ``terms`` reach the threshold."""
    least = SCORE_SHARE - 1e-9
    begins, ends = index.group_at[terms, group], index.group_at[terms, group + 1]
    here = np.flatnonzero(begins < ends)
    # a list: next item, its place, items, weights, the most that the term adds to an item of this group, the term
    lists = [[own[0], 0, own, index.weights[a:b], top, t] for own, a, b, top, t in (
        (index.items[a:b].tolist(), a, b, top, t) for a, b, top, t in zip(
            begins[here].tolist(), ends[here].tolist(), index.group_max[terms[here], group].tolist(), terms[here].tolist()))]
    blocks = int(index.group_items) > BLOCK_ITEMS  # else the group is one block, whose maxima the lists have already
    found = []

    def bound(t: int, block: int) -> float:
        a, b = index.block_at[t], index.block_at[t + 1]
        k = a + np.searchsorted(index.blocks[a:b], block)
        return float(index.block_max[k]) if k < b and index.blocks[k] == block else 0.0

    while lists:
        lists.sort(key=itemgetter(0))
        most, k = 0.0, -1
        for k, x in enumerate(lists):
            most += x[4]
            if most >= least:
                break
        else:
            break
        pivot = lists[k][0]
        while k + 1 < len(lists) and lists[k + 1][0] == pivot:
            k += 1
        if blocks and sum(bound(x[5], pivot // BLOCK_ITEMS) for x in lists[:k + 1]) < least:
            to = (pivot // BLOCK_ITEMS + 1) * BLOCK_ITEMS  # no item of the block, nor any before it, can reach it
            if k + 1 < len(lists):
                to = min(to, lists[k + 1][0])
        elif lists[0][0] == pivot:
            score = float(sum(x[3][x[1]] for x in lists[:k + 1]))
            if score >= least:
                found.append((pivot, score))
            to = pivot + 1
        else:
            to = pivot
        ended = False
        for x in lists[:k + 1]:
            if x[0] < to:
                x[1] = bisect_left(x[2], to, x[1])
                if x[1] < len(x[2]):
                    x[0] = x[2][x[1]]
                else:
                    x[0], ended = -1, True
        if ended:
            lists = [x for x in lists if x[0] >= 0]
    return found


def retrieve(index: ItemIndex, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(row, first word of the passage, item, score) of all passages and items over the threshold.

    A row's passages begin every ``stride`` words and have twice that length, so
    any run of ``stride`` words lies whole in one of them.
    """
    hit = np.flatnonzero(index.maybe[(words & np.uint64(65535)).astype(np.int64)])
    term = np.minimum(np.searchsorted(index.terms, words[hit]), len(index.terms) - 1)
    good = index.terms[term] == words[hit]
    hit, term = hit[good], term[good]
    stride = int(index.stride)
    passages = np.maximum(1, -(-np.diff(bounds) // stride))  # of each row
    first_passage = np.concatenate([[0], np.cumsum(passages)])
    row = np.searchsorted(bounds, hit, "right") - 1
    passage = first_passage[row] + (hit - bounds[row]) // stride
    before = passage > first_passage[row]  # a word is in the passage that begins a stride earlier, too
    passage, term = np.concatenate([passage, passage[before] - 1]), np.concatenate([term, term[before]])
    owner, terms = np.divmod(np.unique(passage * len(index.terms) + term), len(index.terms))
    out = []
    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    edges = np.append(begins, len(owner))
    for k in range(0, len(begins), 256):  # passages whose bounds are held at a time
        a, b = edges[k], edges[min(k + 256, len(begins))]
        bound = np.add.reduceat(index.group_max[terms[a:b]], begins[k:k + 256] - a, axis=0)
        near, group = np.nonzero(bound >= SCORE_SHARE - 1e-4)
        for p, g in zip((near + k).tolist(), group.tolist()):
            at = int(owner[begins[p]])
            r = int(np.searchsorted(first_passage, at, "right")) - 1
            for item, score in block_max_wand(index, terms[edges[p]:edges[p + 1]], g):
                out.append((r, (at - int(first_passage[r])) * stride, item, score))
    return out


def overlaps(index: ItemIndex, item: int, passage: np.ndarray) -> tuple[float, float, bool]:
    """Shares of the question's shingles and of the answer's words that a passage holds, and whether they are enough."""
    question = index.questions[index.q_at[item]:index.q_at[item + 1]]
    answer = index.answers[index.a_at[item]:index.a_at[item + 1]]
    size = int(index.q_size[item])
    q = float(np.isin(question, gram_hashes(passage, size)).mean()) if len(question) else 1.0
    a = float(np.isin(answer, passage).mean()) if len(answer) else 1.0
    return q, a, q >= enough(len(question), size) - 1e-9 and a >= enough(len(answer), 1) - 1e-9


LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def _leaks(parts: Parts, column):
    """(row, item_id, score, overlaps, first word) of verified items, the best passage of each."""
    for i, j, data, offsets in text_slices(column):
        words, bounds = word_hashes(data, offsets, _VALUES)
        for index in parts:
            best = {}
            for r, at, item, score in retrieve(index, words, bounds):
                passage = words[bounds[r] + at:min(bounds[r + 1], bounds[r] + at + 2 * int(index.stride))]
                q, a, good = overlaps(index, item, passage)
                if good and (q, a, score, -at) > best.get((r, item), (0.0,)):
                    best[r, item] = (q, a, score, -at)
            for (r, item), (q, a, score, at) in best.items():
                yield i + r, int(index.item_ids[item]), score, q, a, -at


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word) of benchmark items in ``docs``.

    A document holds an item if a passage of it scores at least half of the
    item's own BM25 score and holds enough of its question's shingles (5 words;
    3 for questions of fewer than 64 words) and of its answer's words: 0.8 of
    them, or all that one changed word leaves, if that is less and at least half.
    Words are runs of letters and digits, A-Z as a-z. One row a document and
    item, for the best passage. Null or empty texts and null ids have no leaks;
    an empty benchmark gives no rows; other columns are not looked at. Repeated
    documents give repeated leaks, repeated items count once.
    """
    spark = docs.sparkSession
    docs = ready(docs).select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    folder, files = build_indexes(benchmark)
    if not files:
        return spark.createDataFrame([], LEAKS)

    def search(batches):
        names, parts = [f.split()[0] for f in LEAKS.split(", ")], Parts(folder, files)
        for batch in batches:
            rows = list(_leaks(parts, batch.column(1)))
            at, items, scores, qs, as_, words = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(items, pa.int64()),
                 pa.array(scores, pa.float64()), pa.array(qs, pa.float64()), pa.array(as_, pa.float64()),
                 pa.array(words, pa.int64())], names)

    return docs.mapInArrow(frugal(search), LEAKS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows with null doc_id stay, and so do
    null and empty texts. Repeated rows stay or go together."""
    return docs.join(find_leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
