"""Later checks of the older training-data operators: odd columns, ids and sizes, and BM25 against the formula."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from seatspark.llm import decontam, kneser_ney, license_scan, line_dedup, ngram_join, packing, shared, token_file, tokens, warc
from seatspark.llm.textops import text_slices

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def _sentence(rnd, n):
    return " ".join("".join(rnd.choices("aeiourstlnm", k=rnd.randint(2, 7))) for _ in range(n))


# ---- 2: line dedup ----

def test_line_dedup_with_clashing_columns_and_long_texts(spark):
    names = ["_doc", "_hash", "places", "_lines", "h1", "h2", "seen", "first", "key", "place", "col", "pos"]
    long = "\n".join(f"line number {k % 700} of a long text" for k in range(40_000))
    rows = [(1, "the same long line\nown line number one"), (2, "The same long line \nown line number two"), (3, long), (4, long), (5, None)]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[1]["n_dropped"] == 0 and got[2]["text"] == "own line number two" and got[5]["text"] == ""
    assert (got[3]["n_dropped"], got[4]["n_dropped"], got[4]["n_lines"]) == (0, 40_000, 40_000)
    assert all(got[2][n] == k for k, n in enumerate(names))
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_line_dedup_batches_hold_as_many_lines_beside_an_outlying_id(spark):
    rows = [(k, f"a line of document {k % 50}") for k in range(400)] + [(2 ** 62, "a line of document 3"), (-2 ** 62, "nothing else here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {k: int(k >= 50) for k in range(400)} | {2 ** 62: 1, -2 ** 62: 0}


# ---- 3: near copies of very long texts ----

def test_join_of_very_long_texts(spark):
    rnd = random.Random(7)
    long = _sentence(rnd, 60_000)
    rows = [(1, long), (2, long + " and a few words more"), (3, _sentence(rnd, 60_000)), (4, "x" * 3_000_000)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_join(
        spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_of_texts_of_odd_blanks_and_special_strings(path):
    rnd = random.Random(1)
    parts = list("ab é漢\u3000\xa0\u1680\u2028\u205f\x85 \n\t .,'sSt1 -ế\x01") + ["<|endoftext|>", " the ", "'s ", "  x", "<|startoftext|>"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 60))) for _ in range(6000)]
    plain, own = Tokenizer.from_file(path), tokens.PieceEncoder(path)
    for i, j, data, offsets in text_slices(pa.array(texts)):
        ids, bounds = own.encode(data, offsets)
        for k in range(j - i):
            assert ids[bounds[k]:bounds[k + 1]].tolist() == plain.encode(texts[i + k], add_special_tokens=False).ids, texts[i + k]


# ---- 1, 4: null and repeated ids ----

def test_packing_and_token_files_of_null_and_repeated_ids(spark):
    rows = [(1, "one two"), (1, "one two"), (1, "three"), (None, "four five"), (2, None), (2, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, piece int")
    got = packing.pack_documents(df, BYTE, capacity=8).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    for bin_ in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == bin_), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 8
    assert packing.pack_documents(df.limit(0), BYTE).collect() == []
    files = sorted(map(tuple, token_file.token_file_digest(spark, df, WORD, 2, 49_408).collect()))
    assert [r[0] for r in files] == [1, 1, 1, 2, 2] and [r[1] for r in files] == list(np.cumsum([0] + [r[2] for r in files])[:-1])


# ---- 6: WARC ----

def test_cuts_hold_even_rows_whatever_the_ids(spark):
    rnd = random.Random(3)
    ids = [rnd.randint(0, 3000) for _ in range(1500)] + [2 ** 63 - 1, -2 ** 63, 2 ** 62 + 5] + [77] * 400 + [None] * 9
    for parts in (1, 6):
        cuts = shared.even_cuts(spark.createDataFrame([(x,) for x in ids], "i long").repartition(parts), 100)
        held = Counter(int(np.searchsorted(cuts, x, "right")) for x in ids if x is not None)
        assert cuts == sorted(set(cuts)) and all(n <= 100 or {x for x in ids if x is not None and int(
            np.searchsorted(cuts, x, "right")) == k} == {77} for k, n in held.items())
        assert len(held) < 45
    assert shared.even_cuts(spark.createDataFrame([], "i long"), 10) == []
    assert shared.even_cuts(spark.createDataFrame([(5,), (5,)], "i long"), 1) == []


def test_warc_of_ids_over_the_full_range(spark, tmp_path):
    rows = [(2 ** 63 - 1, "u", "x" * 150), (-2 ** 63, "u", "x" * 150), (0, "u", "y"), *((k, "u", f"page {k}" * 20) for k in range(1, 60)),
            *((None, "u", f"no id {k}" * 20) for k in range(40))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/a"
    warc.write_warc(df, folder, shard_bytes=1500)
    got = warc.read_warc(spark, folder).collect()
    assert Counter((r["page_id"], r["payload_digest"]) for r in got) == Counter((i, hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows)
    assert {r["page_id"]: r["refers_to"] for r in got if r["record_type"] == "revisit"} == {2 ** 63 - 1: -2 ** 63}
    names = sorted(p.name for p in (tmp_path / "a").iterdir() if p.name.endswith(".gz"))
    assert sum("none" in n for n in names) > 1 and sum("none" not in n for n in names) > 4


# ---- 7: BM25 and its verification ----

def _words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _bm25(items):
    """Weights of each item's terms, as a share of the item's own score, by the formula."""
    words = {k: _words(t) for k, t in items.items()}
    words = {k: w for k, w in words.items() if w}
    df = Counter(t for w in words.values() for t in set(w))
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    out = {}
    for k, w in words.items():
        tf = Counter(w)
        weight = {t: math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, c in tf.items()}
        out[k] = {t: x / sum(weight.values()) for t, x in weight.items()}
    return out


def _passages(words, stride):
    return [(k, words[k:k + 2 * stride]) for k in range(0, max(len(words), 1), stride)]


def _items_and_docs():
    rnd = random.Random(5)
    common = _sentence(rnd, 40).split()
    say = lambda n: " ".join(rnd.choice(common) if rnd.random() < 0.5 else _sentence(rnd, 1) for _ in range(n))
    items = {k: f"{say(rnd.choice([9, 23, 40, 70, 150]))}. {say(3)}." for k in range(90)}
    items |= {200: "", 201: " . ", 202: items[3]}
    docs = []
    for k in range(80):
        w = items[k].split()
        part = w[:int(len(w) * rnd.choice([0.3, 0.5, 0.7, 1]))]
        for _ in range(rnd.choice([0, 1, 3])):
            part[rnd.randrange(len(part))] = "changed"
        docs.append((k, f"{say(rnd.randint(0, 200))} {' '.join(part)} {say(rnd.randint(0, 90))}"))
    return items, docs + [(900, None), (901, ""), (902, say(2000))]


@pytest.mark.parametrize("part_terms, groups", [(1 << 18, 32), (60, 2)])
def test_retrieval_equals_bm25_by_the_formula(spark, monkeypatch, part_terms, groups):
    monkeypatch.setattr(decontam, "PART_TERMS", part_terms)
    monkeypatch.setattr(decontam, "GROUPS", groups)
    items, docs = _items_and_docs()
    weights = _bm25(items)
    folder, files = decontam.build_indexes(spark.createDataFrame(list(items.items()), "item_id long, text string").repartition(3))
    assert (len(files) > 8) == (part_terms == 60)
    got = {}
    for index in decontam.Parts(folder, files):
        for r, (_, text) in enumerate(docs):
            data = np.frombuffer((text or "").encode(), np.uint8)
            words, bounds = decontam.word_hashes(data, np.array([0, len(data)]), decontam._VALUES)
            for _, at, item, score in decontam.retrieve(index, words, bounds):
                got[r, at, int(index.item_ids[item])] = score
    want = {}
    for r, (_, text) in enumerate(docs):
        words = _words(text)
        for k, own in weights.items():
            n = len(_words(items[k]))
            for at, passage in _passages(words, max(64, 1 << (n - 1).bit_length())):
                score = sum(own.get(t, 0) for t in set(passage))
                if score >= 0.5 - 1e-9:
                    want[r, at, k] = score
    assert got.keys() == want.keys() and len(want) > 60
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_leaks_are_the_same_for_any_parts_and_layout(spark, monkeypatch):
    items, docs = _items_and_docs()
    rows = spark.createDataFrame([(*d, 1) for d in docs + docs[:2]], "doc_id long, text string, score int")
    bench = spark.createDataFrame([*items.items(), (5, items[5]), (None, "x y")], "item_id long, text string")
    first = sorted(map(tuple, decontam.find_leaks(rows, bench).collect()))
    monkeypatch.setattr(decontam, "PART_TERMS", 300)
    monkeypatch.setattr(decontam, "HELD_BYTES", 1)
    again = sorted(map(tuple, decontam.find_leaks(rows.repartition(7), bench.repartition(5)).collect()))
    assert len(first) == len(again) > 15
    assert all(a[:2] == b[:2] and a[3:] == b[3:] and math.isclose(a[2], b[2], rel_tol=1e-12) for a, b in zip(first, again))


@pytest.mark.parametrize("n", [12, 23, 60, 200])
def test_items_with_one_word_changed_are_found_and_clean_texts_are_not(spark, n):
    rnd = random.Random(n)
    items = [(k, f"{_sentence(rnd, n)}. {_sentence(rnd, 3)}.") for k in range(40)]
    docs = []
    for k, text in items:
        w = text.split()
        w[rnd.randrange(n)] = "changed"
        docs += [(k, f"{_sentence(rnd, 150)} {text} {_sentence(rnd, 150)}"), (100 + k, f"{_sentence(rnd, 150)} {' '.join(w)} {_sentence(rnd, 90)}"),
                 (200 + k, " ".join(rnd.sample(w, len(w)))), (300 + k, _sentence(rnd, 500))]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k in range(40)} | {(100 + k, k) for k in range(40)}


# ---- 9: counts ----

def test_counts_beyond_32_bits_are_kept(tmp_path):
    big = np.array([3, 2 ** 32 + 5, 2 ** 40], np.int64)
    low = np.array([1, 5, 9], np.uint64)
    for column, kind in ((big, "l"), (np.array([3, 4, 2 ** 32 - 1]), "I")):
        (tmp_path / "000000.hash").write_bytes(b"".join(kneser_ney.HashFile.parts(low, [kneser_ney._narrow(column), kneser_ney._narrow(big)])))
        found = kneser_ney.HashFile(str(tmp_path / "000000.hash"))
        assert found.columns[0].dtype.char == kind and found.columns[0].tolist() == column.tolist()
        assert found.columns[1].tolist() == big.tolist()
        assert found.find(np.array([0, 1, 5, 6, 9], np.uint64)).tolist() == [-1, 0, 1, -1, 2]


def test_summed_block_counts_pass_32_bits(monkeypatch):
    low = np.array([7, 7, 7, 8], np.uint64)
    low, (total,) = kneser_ney._sum_by(low, [np.array([2 ** 32 - 1, 2 ** 32 - 1, 2, 1], np.uint32)])
    assert total.tolist() == [2 ** 33, 1] and kneser_ney._narrow(total).dtype == np.int64


# ---- 10: licences ----

@pytest.mark.parametrize("text, labels", [
    ("// SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"),
    ("# SPDX-License-Identifier: MIT\nimport os", "mit"),
    ("see https://creativecommons.org/licenses/by-sa/4.0/ for it", "cc-by-sa"),
    ("Text under CC BY-SA 4.0. Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
     "use, compile, sell, or distribute this software", "unlicense"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
     "Public License as published by the Free Software Foundation; either version 2.1 of the License", "lgpl-2.1"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
     "Public License as published by the Free Software Foundation, either version 3 of the License", "agpl-3"),
    ("This work is not licensed under the GNU General Public License, version 3.", ""),
    ("It was never released under the MIT License.", "mit"),  # the plain phrase stays, whatever stands before it
    ("never licensed under CC BY-SA 4.0.", ""),
    ("a license identifier of no kind, mit or other", ""),
])
def test_notices_identifiers_addresses_and_negations(spark, text, labels):
    df = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, "w " * 50_000 + text + " w" * 50_000, 0)], "doc_id long, text string, score int")
    assert [r["labels"] for r in license_scan.scan_licences(df).collect()] == [labels] * 3


def _brute_places(text):
    words = _words(text)
    out = []
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        out += [(k, label) for k in range(len(words)) if words[k:k + len(p)] == p]
    return words, out


def test_plain_phrases_equal_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = "under the mit license apache version 2 cc by nc CC-BY NC_ \n é Under".split(" ")
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 60))) for _ in range(300)]
    got = {r["doc_id"]: r for r in license_scan.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        words, found = _brute_places(text)
        places = [p for p, _ in found]
        assert (got[k]["n_words"], got[k]["n_base"], got[k]["first_word"], got[k]["last_word"], got[k]["base_labels"]) == (
            len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found})))
        assert set(got[k]["base_labels"].split(",")) <= set(got[k]["labels"].split(",")) or not found


# ---- pipeline ----

def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item of some words. and more.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_of_null_and_repeated_rows(spark, tmp_path):
    import corpus_pipeline
    rnd = random.Random(3)
    texts = [_sentence(rnd, 40) for _ in range(6)]
    rows = [(k, t, "en", None, None) for k, t in enumerate(texts)] + [(0, texts[0], "en", None, None), (None, texts[1], None, None, None), (9, None, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([0, 0, 1, 2, 3, 4, 5, None])
