"""Training-data operators against brute force on small tables with odd rows."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from seatspark.llm import (ann, components, decontam, kneser_ney, langid, license_scan, line_dedup, ngram_join, packing,
                           token_file, tokens, warc)

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def _lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def _words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", _lower(s))


def _sentence(rnd, n):
    return " ".join("".join(rnd.choices("aeiourstlnm", k=rnd.randint(2, 7))) for _ in range(n))


def _corpus():
    """Texts with copies, edits, shared lines, odd white space, long, short, empty and null ones."""
    rnd = random.Random(4)
    texts = [_sentence(rnd, rnd.randint(1, 120)) for _ in range(60)]
    base = _sentence(rnd, 200).split()
    for k in range(12):  # an original and edited copies
        w = list(base)
        for _ in range(k // 2):
            w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    line = "A line that Several documents hold"
    texts += [f"{texts[1]}\n {line}\t\n{texts[2]}", f"{line.upper()}\n{line}", texts[5], texts[5], texts[5].upper(),
              "", None, " \n\t ", "x", "one two three", "one  two\nthree", "é Ünïcode ñ 漢字 ___", "12 34 !!",
              " ".join(texts[:40]), "\n".join([line] * 30), "a\n" * 50]
    return [(k * 3 + 1, t, "en" if k % 5 else None, "s", 0, 1.0) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


ODD = ["", "  a  b\n\n c <|endoftext|> d", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  z",
       "<|ENDOFTEXT|> <|EndOfText|>\n", "<|startoftext|> é <|startoftext|>", "<|endoftext|", "<|end oftext|> a b",
       "é " * 50 + "<|endoftext|>" + " w" * 50, " it's I'LL 's x", "é ế ́e ÀÉ Σας ΟΔΟΣ x", " a ", "a ", "\n b\t c", "x  y  z",
       "123 456 12a ...!! \"x\" a. b\x01 c"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_piece_encoder_equals_the_tokenizer(path):
    plain, own = Tokenizer.from_file(path), tokens.PieceEncoder(path)
    texts = ODD + [t or "" for _, t, *_ in _corpus()]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    ids, bounds = own.encode(np.frombuffer(b"".join(data), np.uint8), offsets)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids, t


# ---- 1: packing ----

def test_bin_completion_packs_everything_near_the_bound():
    rnd = random.Random(1)
    for capacity, n in ((10, 40), (100, 300), (2048, 500)):
        counts = Counter(rnd.randint(1, capacity) for _ in range(n))
        plan = packing.complete_bins(counts, capacity)
        used = Counter()
        for filling, times in plan:
            assert sum(s * k for s, k in filling) <= capacity
            for s, k in filling:
                used[s] += k * times
        assert used == counts
        assert sum(t for _, t in plan) <= sum(t for _, t in packing.best_fit(counts, capacity))
    assert packing.complete_bins({}, 10) == []
    # best-fit decreasing takes four sequences here, completion three
    assert sum(t for _, t in packing.complete_bins({6: 1, 5: 2, 4: 1, 3: 2, 2: 2}, 10)) == 3


def test_packing_is_gapless_and_whole(spark, docs):
    plain = Tokenizer.from_file(BYTE)
    got = packing.pack_documents(docs, BYTE, capacity=64).toPandas()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got.itertuples():
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    for doc_id, text, *_ in _corpus():
        ids, at = plain.encode(text or "", add_special_tokens=False).ids + [0], 0
        for k, (piece, start, length, crc) in enumerate(sorted(pieces[doc_id])):
            assert (piece, start) == (k, at)
            assert crc == zlib.crc32(np.array(ids[at:at + length], "<u4").tobytes())
            at += length
        assert at == len(ids) and len(pieces[doc_id]) == -(-len(ids) // 64)
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 64
    made = packing.sequences(spark.createDataFrame(got), docs, BYTE).collect()
    assert len(made) == len(bins) and sum(len(r["ids"]) for r in made) == got["length"].sum()


# ---- 2: lines ----

def test_line_dedup_keeps_the_first_document(docs):
    holders, want = defaultdict(set), {}
    key = lambda s: _lower(s.strip(" \t\n\x0b\f\r"))
    for doc_id, text, *_ in _corpus():
        for s in (text or "").split("\n"):
            holders[key(s)].add(doc_id)
    for doc_id, text, *_ in _corpus():
        lines = (text or "").split("\n")
        kept = [s for s in lines if len(key(s)) < 10 or min(holders[key(s)]) == doc_id]
        want[doc_id] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    for batches, fan_in in ((1, 2), (5, 2)):
        got = line_dedup.dedup_lines(docs, batches=batches, fan_in=fan_in)
        assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
        assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()} == want


def test_line_dedup_of_odd_rows(spark):
    rows = [(1, "the same long line", 7), (1, "the same long line", 7), (None, "the same long line", 7), (2, "The same long line ", 7)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int")).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"], r["text"]) for r in got) == [
        (0, 0, "the same long line"), (1, 0, "the same long line"), (1, 0, "the same long line"), (2, 1, "")]


# ---- 3: shingle join ----

def _components(rows, n, percent):
    sets = {}
    for doc_id, text, *_ in rows:
        w = _words(text)
        sets[doc_id] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in ids}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_ngram_join_equals_all_pairs(docs, n, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(docs, n, percent).collect()}
    assert got == _components(_corpus(), n, percent)


def test_signature_tree_prunes_no_link():
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 1 << 48, 60, dtype=np.uint64) for _ in range(30)]
    sets = []
    for k in range(300):
        s = base[k % 30].copy()
        s[rng.choice(60, rng.integers(0, 12), replace=False)] = rng.integers(0, 1 << 48, dtype=np.uint64)
        sets.append(np.unique(s))
    keys, sizes, comps = np.arange(300), np.array([len(s) for s in sets]), np.arange(300)
    for side in (np.zeros(300, int), np.arange(300) % 2):
        found = ngram_join._traverse_run(keys, sizes, comps, [ngram_join._signature(s) for s in sets], side, 80)
        for a in range(300):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and (side.max() == 0 or side[a] != side[b]):
                    assert (b, a) in found
        assert len(found) < 300 * 299 // 8


def test_join_of_odd_rows(spark, empty):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (3, None)]
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [
        (0, 2, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert ngram_join.ngram_jaccard_join(empty).collect() == []


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(0, 200) if k % 50 != 49] + [(None, 3), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: k // 50 * 50 for k in range(0, 200)} | {200: 200 // 50 * 50} or got == {
        k: k // 50 * 50 for k in range(0, 200)}


# ---- 4: token files ----

def test_bits_round_trip():
    rng = np.random.default_rng(0)
    for width in (1, 3, 7, 16, 17, 31):
        x = rng.integers(0, 1 << width, 1000).astype(np.uint32)
        assert (token_file.unpack(token_file.pack(x, width), width, 1000) == x).all()
    assert token_file.bit_width(49_408) == 16 and token_file.bit_width(1) == 1


def test_token_files_read_back(spark, docs, empty):
    plain, at, want = Tokenizer.from_file(WORD), 0, []
    for doc_id, text, *_ in sorted(_corpus()[:0] + [(r[0], r[1] or "") for r in _corpus()]):
        ids = plain.encode(text, add_special_tokens=False).ids + [2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_file.token_file_digest(spark, docs, WORD, 2, 49_408).collect()
    assert sorted(map(tuple, got)) == want
    assert token_file.token_file_digest(spark, empty, WORD, 2, 49_408).collect() == []


def test_token_file_random_access(tmp_path):
    from pyarrow import fs
    ids = np.arange(20_000, dtype=np.uint32) % 49_408
    parts = token_file._file_parts(np.array([5, 9]), np.array([0, 7, 20_000]), [token_file.pack(ids[:16384], 16),
                                                                            token_file.pack(ids[16384:], 16)], 16)
    (tmp_path / "f").write_bytes(b"".join(parts))
    with token_file.TokenFile(fs.LocalFileSystem(), str(tmp_path / "f")) as f:
        for a, b in ((0, 7), (7, 20_000), (8190, 8195), (19_999, 20_000), (3, 3)):
            assert f.ids(a, b).tolist() == ids[a:b].tolist()


# ---- 5: nearest neighbours ----

def test_nearest_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    x[100:400] = x[100]
    rows = [(k, v.tolist(), k) for k, v in enumerate(x)]
    rows += [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [float("nan")] + [1.0] * 15, 0), (5003, [1.0] * 3, 0),
             (5004, [None] + [1.0] * 15, 0), (None, [1.0] * 16, 0), (7, x[7].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = defaultdict(list)
    for r in sorted(ann.search(df, df.where("vec_id % 100 = 0"), enough=600).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        hits += len(set(best.tolist()) & {k for k, _ in got[q]})
        assert all(abs(d[k] - s) < 1e-12 for k, s in got[q]) and len(got[q]) == 10
    assert hits >= 0.9 * 300
    assert [k for k, _ in got[100]] == list(range(101, 111))
    assert set(got) == set(range(0, 3000, 100))
    assert ann.search(df.where("vec_id is null"), df).collect() == []
    few = df.where("vec_id < 4")
    assert ann.search(few, few).count() == 12


def test_nearest_neighbours_are_exact_when_cells_are_left_out(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(16000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    x[12000:] = x[:1] + 0.01 * x[12000:]  # a quarter of them in one narrow group: blocks that some queries skip
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 400 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q in range(0, 16000, 400):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert got[q] == np.lexsort((np.arange(16000), d))[:10].tolist()


def test_cells_left_out_hold_no_near_vector():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8, 6))[rng.integers(0, 8, 2000)] + 0.1 * rng.normal(size=(2000, 6))
    halves = ann.k_means(x[:, :3], 8), ann.k_means(x[:, 3:], 8)
    at = [ann._distances(x[:, s], c).argmin(1) for s, c in zip((slice(0, 3), slice(3, 6)), halves)]
    d = np.stack([np.sqrt(((x[:, s] - c[a]) ** 2).sum(1)) for s, c, a in zip((slice(0, 3), slice(3, 6)), halves, at)], 1)
    cell = at[0] * len(halves[1]) + at[1]
    cells = np.unique(cell)
    near, far = (np.array([f(d[cell == c], axis=0) for c in cells]) for f in (np.min, np.max))
    skipped = 0
    for q in x[::50]:
        away = np.sqrt(((x - q) ** 2).sum(1))
        bound = np.sort(away)[10]
        kept = ann.cells_within(q, halves, cells, near, far, bound)
        assert set(cell[away <= bound]) <= set(kept.tolist())
        skipped += len(cells) - len(kept)
    assert skipped > 0
    blocks = ann.blocks_of({5: 3, 1: 4, 9: 25, 10: 1, 11: 10, 12: 2}, rows=10)
    assert blocks == {1: (0, 1), 5: (0, 1), 9: (1, 3), 10: (4, 1), 11: (5, 1), 12: (6, 1)}


# ---- 6: WARC ----

def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 200 + "é</p>"
    rows = [(5, "http://a/\r\nX: y", big), (2, "u", big), (9, None, big), (3, "u", None), (4, "u", ""), (-7, "u", "<b>small</b>"),
            (8, "u", "<b>small</b>"), (2 ** 62 + 5, "u", "z" * 150), (None, "u", big), (11, "u", "q" * 99), (12, "u", "q" * 99)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    folders = [f"file://{tmp_path}/{k}" for k in range(2)]
    for folder, parts in zip(folders, (1, 4)):
        warc.write_warc(df.repartition(parts), folder, shard_bytes=200, roll_bytes=100)
    got = {r["page_id"]: r for r in warc.read_warc(spark, folders[0]).collect()}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        first = min((p for p, _, h in rows if p is not None and h == html), default=None)
        again = page_id is not None and len(payload) >= 100 and first != page_id
        r = got[page_id]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if again else ("response", None))
        assert again or bytes(r["payload"]) == payload
    names = [sorted(p.name for p in (tmp_path / str(k)).iterdir() if p.name.endswith(".gz")) for k in range(2)]
    assert names[0] == names[1] and len(names[0]) > 2  # the same bytes however the input is dealt out
    assert all((tmp_path / "0" / n).read_bytes() == (tmp_path / "1" / n).read_bytes() for n in names[0])
    damaged = (tmp_path / "0" / names[0][-1]).read_bytes()[:-5]
    with pytest.raises(ValueError):
        list(warc.read_records(iter([damaged])))
    assert warc.archive_pages(df.limit(0)).collect() == []


# ---- 7: decontamination ----

def test_leaks_equal_brute_force(spark, docs, empty):
    rnd = random.Random(8)
    items = [(k, f"{_sentence(rnd, rnd.randint(8, 150))} the of and. {_sentence(rnd, 3)}.") for k in range(40)]
    rows = []
    for k in range(60):
        pad = _sentence(rnd, rnd.randint(0, 300)) + " the of and "
        item = items[k % 40][1]
        rows.append((k, f"{pad}{item.upper() if k % 3 == 0 else item} {pad}" if k % 2 else f"{pad}{' '.join(item.split()[::-1])}"))
    rows += [(100, None), (101, ""), (None, items[0][1]), (102, items[3][1] + " " + items[7][1])]
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double")
    benchmark = spark.createDataFrame([*items, (90, None), (91, "  "), (None, "x y")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, benchmark).collect()}
    assert got == {(k, k % 40) for k in range(60) if k % 2} | {(102, 3), (102, 7)}
    left = {r["doc_id"] for r in decontam.drop_leaks(df, benchmark).collect()}
    assert left == {k for k in range(60) if not k % 2} | {100, 101, None}
    assert decontam.find_leaks(empty, benchmark).collect() == []
    assert decontam.find_leaks(df, benchmark.limit(0)).collect() == []


# ---- 8: language ----

def test_language_of_held_out_texts(spark, empty):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(90001, None, "en"), (90002, " 12 !", None), (90003, "", "fr")], df.schema)
    got = langid.identify_languages(df.unionByName(odd)).toPandas()
    held = got[got.held_out & got.lang.notna() & (got.lang_pred != "und")]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97
    assert set(got[got.doc_id > 90000].lang_pred) == {"und"}
    assert got.score.between(0, 1).all()
    crc = {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in got.doc_id}
    assert all(crc[k] == h for k, h in zip(got.doc_id, got.held_out))
    assert langid.identify_languages(empty).collect() == []


def test_language_sample_counts_copies_once(spark, monkeypatch):
    rows = [(k, f"mot {k} du texte", "fr") for k in range(1000)] + [(k, f"word {k} of text", "en") for k in range(300)]
    rows += [(k, "une copie", "fr") for k in range(20000)] + [(1, "rare", "de")] + [(2, "copia", "es")] * 5000
    rows += [(k, " " * (k + 1), "en") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "train", lambda texts, labels, **_: list(zip(labels, texts)))
    got = langid.fit_language_model(df, F.lit(True))
    assert Counter(k for k, _ in got) == {"fr": 800, "en": 300, "de": 1, "es": 1}
    assert len(set(got)) == len(got)
    lowest = df.where("lang = 'fr'").distinct().select("text").distinct().orderBy(F.xxhash64("text")).limit(800)
    assert {t for k, t in got if k == "fr"} == {r["text"].encode() for r in lowest.collect()}


def test_language_sample_spreads_over_long_texts_and_takes_every_label(spark, monkeypatch):
    rows = [(k, "licence header " * 300 + "漢字仮名交じり文" * 3000, "ja") for k in range(40)]
    rows = [(k, t + str(k), x) for k, t, x in rows] + [(k, f"text {k}", f"l{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "train", lambda texts, labels, **_: list(zip(labels, texts)))
    got = langid.fit_language_model(df, F.lit(True))
    assert {k for k, _ in got} == {"ja"} | {f"l{k}" for k in range(300)}
    whole = {t.encode() for _, t, _ in rows}
    starts = set()
    for t in (t for k, t in got if k == "ja"):
        home = next(w for w in whole if w[-2:] == t[-2:] or t[-256:] in w)
        assert 7 * 256 < len(t) <= 2048 and all(t[k:k + 256] in home for k in range(0, len(t), 256))
        assert t.count(b"licence") < 40 and len(t.decode(errors="ignore")) < 1200
        starts.add(t[-256:])
    assert len(starts) > 1


def test_pipeline_keeps_documents_when_no_label_is_known(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, " 12 !", None), (3, None, None), (4, "漢字", None)],
                               "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.languages(spark, df, "").collect()} == {1, 4}


# ---- 9: language model ----

def test_kneser_ney_equals_the_formula(spark, docs, empty):
    rows = [(i, t) for i, t, *_ in _corpus()]
    train = [_words(t) + ["\0"] for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    words, pairs = Counter(), Counter()
    for w in train:
        words.update(w)
        pairs.update(zip(["\1", *w], w))
    after, before, total = defaultdict(Counter), Counter(), Counter()
    for (h, w), c in pairs.items():
        after[h][min(c, 3)] += 1
        before[w] += 1
        total[h] += c
    d = kneser_ney._discounts(*(sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)))
    e = kneser_ney._discounts(*(sum(c == k for c in before.values()) for k in (1, 2, 3, 4)))
    n, v, kinds = sum(words.values()), len(words), len(pairs)
    weight = sum(e[min(c, 3)] for c in before.values()) / kinds

    def p(h, w):
        low = max(before[w] - e[min(before[w], 3)], 0) / kinds + weight / (v + 1)
        if not total[h]:
            return low
        c = pairs[h, w]
        return (max(c - d[min(c, 3)], 0) + sum(d[k] * after[h][k] for k in (1, 2, 3)) * low) / total[h]

    for h in ("\1", train[0][0], "never"):
        assert abs(sum(p(h, w) for w in words) + p(h, "unseen") - 1) < 1e-9
    out = langid.held_out(F.col("doc_id"), 7, 2)
    got = {r["doc_id"]: r for r in kneser_ney.fit_and_score(docs.select("doc_id", "text"), ~out).collect()}
    for i, t in rows:
        w = _words(t) + ["\0"]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(words[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(h, x)) for h, x in zip(["\1", *w], w)), rel_tol=1e-6)
    assert kneser_ney.fit_and_score(empty, F.lit(True)).collect() == []
    alone = kneser_ney.fit_and_score(docs.select("doc_id", "text").limit(3), F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["score"] <= 0 for r in alone)


# ---- 10: licences ----

def test_licences(spark, empty):
    pad = "some words before it "
    mit = dict((t[0], t[1]) for t in license_scan.TEMPLATES[:1])["mit"]
    rows = [(1, pad + "Under the MIT License. " + pad), (2, "Apache-License, version 2!"), (3, "CC BY-NC " * 3), (4, None),
            (5, ""), (6, pad + mit.replace("hereby granted", "hereby  granted").upper() + pad),
            (7, "This work is licensed under the GNU General Public License, version 3."), (8, "Released under the MIT License."),
            (9, "the licence of this work is general public and free"), (None, "cc by nc"), (10, mit.replace("copy", "thing") + pad),
            (11, "permission to use this software is granted free of charge to no person")]
    got = {r["doc_id"]: r for r in license_scan.scan_licences(
        spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (1, 4, 4, "mit")
    assert (got[2]["n_words"], got[2]["n_base"], got[2]["labels"]) == (4, 1, "apache-2")
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"]) == (3, 0, 6)
    assert got[4]["n_words"] == got[5]["n_words"] == 0 and got[4]["first_word"] is None
    assert got[6]["labels"] == got[10]["labels"] == "mit" and got[6]["base_labels"] == "" and got[6]["score"] > 0.6
    assert got[7]["labels"] == "gpl-3" and got[8]["labels"] == "mit" and got[8]["base_labels"] == "mit"
    assert got[9]["labels"] == got[11]["labels"] == "" and got[9]["score"] == 0
    assert got[None]["labels"] == "cc-by-nc"
    assert license_scan.scan_licences(empty).collect() == []


# ---- pipeline ----

def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(3)
    copy, line = _sentence(rnd, 90), "a line that many documents of this corpus hold"
    item = _sentence(rnd, 40) + ". " + _sentence(rnd, 4) + "."
    rows = [(k, f"{_sentence(rnd, 60)}\n{line}", "en", "s", 0) for k in range(30)]
    rows += [(40, copy, "en", "s", 0), (41, copy + " end", "en", "s", 0), (42, f"{_sentence(rnd, 50)} {item}", "en", "s", 0),
             (43, " 12 !", "en", "s", 0), (44, None, "en", "s", 0), (45, copy, None, None, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, gone = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == [c.split()[0] for c in columns.split(", ")]
        gone.append(before - {r["doc_id"] for r in docs.select("doc_id").collect()})
    # 41 and 45 are copies of 40; the lines that 45 and 41 share with 40 are single-line texts
    assert gone[0] == {43, 44} and gone[1] == set() and gone[3] == {42}
    assert sum(line in (r["text"] or "") for r in docs.collect()) == 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == {r["doc_id"] for r in docs.collect()}
    assert gone[2] == {41}
