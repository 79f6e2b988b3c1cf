"""Vector codes, importance resampling and fingerprints against brute force on small tables with odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from seatspark.llm import fingerprints, importance, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, v array<int>"
DOCS = "doc_id long, text string, weight long, rank int, _out int"


# ---- 11: vector codes ----

def test_limb_products_are_exact():
    rnd = random.Random(3)
    for length, bits in ((1, 30), (8, 28), (8, 10), (64, 27), (2000, 24), (3, 0)):
        a = np.array([[rnd.randint(-2 ** bits, 2 ** bits) for _ in range(length)] for _ in range(5)], np.int64)
        b = np.array([[rnd.randint(-2 ** bits, 2 ** bits) for _ in range(length)] for _ in range(4)], np.int64)
        a[0], b[0] = 2 ** bits, -2 ** bits
        want = [[sum(x * y for x, y in zip(r, s)) for s in b.tolist()] for r in a.tolist()]
        assert vector_codes.exact_products(a, b).tolist() == want
        assert length * (2 ** vector_codes.limb_bits(length)) ** 2 <= 2 ** 53
    # more than two limbs each
    a = np.array([[2 ** 40 + 3, -5]], np.int64)
    b = np.array([[2 ** 20 + 1, 2 ** 40 + 7]], np.int64)
    assert vector_codes.exact_products(a, b).tolist() == [[(2 ** 40 + 3) * (2 ** 20 + 1) - 5 * (2 ** 40 + 7)]]


def _kept(rows):
    return [r for r in rows if r[1] is not None and len(r[1]) and all(c is not None and math.isfinite(c) for c in r[1])]


def _brute_codes(rows, parts, entries, rounds, scale):
    """The contract's steps one vector at a time, with Python integers."""
    kept = sorted(_kept(rows), key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return Counter()
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    n = len(kept[0][1])
    cuts = [n * k // parts for k in range(parts + 1)]
    ints = [[math.floor(scale * float(np.float32(c))) for c in r[1]] for r in kept]
    books = [[v[a:b] for v in ints[:entries]] for a, b in zip(cuts, cuts[1:])]
    dist = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y))

    def pick(x, book):
        return min(range(len(book)), key=lambda e: (dist(x, book[e]), e))

    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            groups = defaultdict(list)
            for v in ints:
                groups[pick(v[a:b], books[p])].append(v[a:b])
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else books[p][e]
                        for e in range(len(books[p]))]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out, errors = [], Counter()
    for r, v in zip(kept, ints):
        codes = [pick(v[a:b], books[p]) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        error = sum(dist(v[a:b], books[p][e]) for p, (a, b, e) in enumerate(zip(cuts, cuts[1:], codes)))
        errors[r[2]] += error
        out.append((r[0], "".join(f"{e:02x}" for e in codes), error, r[2]))
    return Counter((i, c, e, errors[lb], digest) for i, c, e, lb in out)


def _vectors(n, length, spread, seed=1):
    rnd = random.Random(seed)
    return [(k * 7 % 1000, [float(np.float32(rnd.gauss(0, spread))) for _ in range(length)], rnd.choice([1, 1, 1, 2, None]),
             "x", None) for k in range(n)]


@pytest.mark.parametrize("rows, parts, entries", [
    (_vectors(80, 16, 0.2), 8, 16),
    (_vectors(60, 16, 9000.0), 8, 16),  # two limbs
    (_vectors(40, 10, 0.01), 4, 5),  # parts of unequal size, many equal components
    (_vectors(5, 8, 1.0), 8, 16),  # fewer vectors than entries
])
def test_codes_equal_brute_force(spark, rows, parts, entries):
    odd = [(9001, None, 1, "", []), (9002, [None] * 16, 1, "", []), (9003, [math.nan] * 16, None, "", []),
           (9004, [math.inf] + [0.0] * 15, 2, "", []), (9005, [-math.inf] * 16, 2, "", []), (9006, [], 1, "", []),
           (9007, [1.0, 2.0, 3.0], 1, "", []), (None, [0.25] * len(rows[0][1]), 2, "", []),
           (None, [0.25] * len(rows[0][1]), 2, "", []), (9008, [0.0] * len(rows[0][1]), None, "", [])]
    rows = rows + odd + rows[:3] + [(0, [0.5] * len(rows[0][1]), 1, "", [])]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = vector_codes.compress(df, parts=parts, entries=entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == _brute_codes(rows, parts, entries, 6, 4096)


def test_codes_of_empty_and_too_large_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress(none).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1, "", [])], VECTORS)).collect() == []
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1, "", [])], VECTORS))


def test_codes_decode_to_their_entries(spark):
    rows = _vectors(50, 16, 0.2, seed=5)
    ints = vector_codes.integer_vectors(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", "label", 4096)
    found = vector_codes.fit(ints, 8, 16, 6, 4096)
    for r in vector_codes.encode(ints, found).collect():
        at = found.decode(r["code"])
        own = [math.floor(4096 * c) for c in next(v for i, v, *_ in rows if i == r["vec_id"])]
        assert sum((a - round(4096 * b)) ** 2 for a, b in zip(own, at)) == r["error"]


# ---- 12: importance resampling ----

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(text):
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _runs(text, most):
    w = _words(text)
    return [" ".join(w[i:i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def _brute_draw(docs, target, most, buckets, percent, least, seed):
    deal = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(deal(f) for _, x in side for f in _runs(x, most)) for side in (docs, target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets))))
    rows = []
    for i, x in docs:
        f = _runs(x, most)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(deal(a)) for a in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), len(_words(x))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    drawn = able[:percent * len(able) // 100]
    out = Counter()
    for r in rows:
        places = [k + 1 for k, d in enumerate(drawn) if d is r]
        out[(*r[:4], places[0] if places else None)] += 1
    return out


def _texts():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abÉé漢0", k=rnd.randint(1, 9)))
    base = [word() for _ in range(60)]
    texts = [" ".join(rnd.choices(base, k=rnd.randint(0, 60))) for _ in range(70)]
    return texts + [None, "", " \n ", "The  the,THE-the", "x" * 3000 + " " + "y" * 300, texts[0], texts[0], "Ünïcode" * 50,
                    "a_b`c{d\x7fe f", "".join(chr(c) for c in range(1, 300))]


@pytest.mark.parametrize("most, buckets, least", [(1, 10_000, 20), (3, 97, 5)])
def test_draw_equals_brute_force(spark, most, buckets, least):
    docs = list(enumerate(_texts())) + [(None, _texts()[3]), (None, "b b"), (5, _texts()[9]), (5, _texts()[5])]
    target = [(0, _texts()[1]), (1, None), (2, "The the")]
    df = spark.createDataFrame([(i, x, 1, 2, 3) for i, x in docs], DOCS).repartition(4)
    goal = spark.createDataFrame(target, "item_id long, text string")
    got = importance.resample(df, goal, most=most, buckets=buckets, percent=30, least_words=least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == _brute_draw(docs, target, most, buckets, 30, least, "2024")


def test_draw_of_empty_tables_and_the_documents_drawn(spark):
    none = spark.createDataFrame([], DOCS)
    goal = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(none, goal).collect() == []
    docs = spark.createDataFrame([(i, x, 1, 2, 3) for i, x in enumerate(_texts())], DOCS)
    rows = importance.resample(docs, goal, percent=50).where("rank is not null").collect()
    got = importance.drawn_documents(docs, goal, percent=50)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in rows} and rows


def test_crcs_equal_zlib():
    rnd = np.random.default_rng(2)
    data = rnd.integers(1, 256, 5000).astype(np.uint8)
    lengths = np.array([1, 1, 2, 3, 8, 9, 9, 64, 256, 257, 900] * 20, np.int64)
    starts = rnd.integers(0, 4000, len(lengths))
    want = [zlib.crc32(data[s:s + n].tobytes()) for s, n in zip(starts.tolist(), lengths.tolist())]
    assert importance.crcs(data, starts, lengths).tolist() == want


# ---- 13: fingerprints ----

def test_entropy_levels_equal_the_definition():
    rnd = random.Random(6)
    data = np.frombuffer(bytes(rnd.choices(b"aaaabcdefgh \n", k=400)) + b"z" * 60, np.uint8)
    w = fingerprints.WINDOW
    got = fingerprints.entropy_levels(data)
    for k in range(len(data) - w + 1):
        n = Counter(data[k:k + w].tolist()).values()
        share = -sum(c / w * math.log2(c / w) for c in n) / math.log2(w)
        assert abs(share * (fingerprints.LEVELS - 1) - got[k]) <= 1.001
    assert len(fingerprints.entropy_levels(data[:w - 1])) == 0


def _prose(rnd, n):
    return " ".join("".join(rnd.choices("aeiourstlnmkpd", k=rnd.randint(2, 9))) for _ in range(n))


def _edit_rows():
    rnd = random.Random(12)
    texts = [_prose(rnd, rnd.randint(15, 400)) for _ in range(40)]
    texts += ["", None, "x", "ab", "aaaa" * 500, "漢字é " * 30, "\n" * 9, texts[3], texts[3], texts[3] + " and more words", "ok " + texts[4]]
    rnd.shuffle(texts)
    return [(k * 5, t) for k, t in enumerate(texts)]


def _brute_edits(rows):
    """doc_id -> (n_chars, sha of the edited text, edited text, next text)."""
    rows, out = sorted(rows, key=lambda r: -r[0]), {}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), edited, after)
    return out


@pytest.mark.parametrize("group_bytes", [1, 3000, 16 << 20])
def test_edits_and_fingerprints(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(fingerprints, "GROUP_BYTES", group_bytes)
    rows = _edit_rows()
    docs = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], DOCS).repartition(4)
    rank = fingerprints.fit_rarity(docs)
    got = {r["doc_id"]: r for r in fingerprints.compare_with_edits(docs).collect()}
    alone = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs, rank).collect()}
    want, print_of = _brute_edits(rows), {}
    assert len(got) == len(rows) and set(got) == set(want)
    for i, t in rows:
        n, sha, edited, after = want[i]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (n, sha, alone[i])
        assert print_of.setdefault(t or "", r["fingerprint"]) == r["fingerprint"]
        own, made, next_ = (_print(x, rank) for x in (t or "", edited, after))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, made)
        decoded = [fingerprints.from_text(x) for x in (own, made, next_)]
        assert r["near_edited"] == fingerprints.likeness(decoded[0], decoded[1])
        assert r["near_next"] == fingerprints.likeness(decoded[0], decoded[2])
        if n > 150 and len(set(t)) > 8 and len(edited) == n and t != after:
            assert r["near_edited"] > 0.1 and r["near_edited"] > r["near_next"]
    assert len(set(print_of.values())) >= len(print_of) - 1  # a few words more at the end may change no feature


def _print(text, rank):
    """A fingerprint by plain loops: entropies, votes, features and filter bits one by one."""
    f, data = fingerprints, text.encode()
    w, hashes = f.WINDOW, []
    if len(data) >= w:
        array = np.frombuffer(data, np.uint8)
        level, h = rank[f.entropy_levels(array)], f._window_hashes(array, w)
        votes = Counter()
        for k in range(len(h) - f.SPAN + 1):
            best = min(range(k, k + f.SPAN), key=lambda i: (level[i], int(h[i]) >> 42, i))
            if level[best] < f.LEVELS:
                votes[best] += 1
        hashes = [int(h[i]) for i in sorted(votes) if votes[i] >= (1 if i < f.HEAD else f.VOTES)]
    if data and (len(data) < f.SHORT or not hashes):
        hashes = [int(x) for x in f._small_windows(np.frombuffer(data, np.uint8))]
    seen, bits = Counter(), set()
    for k, x in enumerate(hashes):
        mixed = int(f.mix(np.array([(x + seen[x]) % 2 ** 64], np.uint64))[0])
        seen[x] += 1
        bits |= {(k // f.FEATURES, (mixed >> (11 * j)) % f.BITS) for j in range(f.HASHES)}
    out = np.zeros((-(-len(hashes) // f.FEATURES), f.BITS), np.uint8)
    for row, bit in bits:
        out[row, bit] = 1
    return base64.b64encode(np.packbits(out, axis=1).tobytes()).decode()


def test_blocks_of_a_long_text_give_the_same_features(monkeypatch):
    rnd = random.Random(9)
    text = _prose(rnd, 3000).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    rank = fingerprints.rarity(np.arange(fingerprints.LEVELS))
    whole = fingerprints.digests(data, offsets, rank)
    monkeypatch.setattr(fingerprints, "SLICE_BYTES", 1000)
    cut = fingerprints.digests(data, offsets, rank)
    assert np.array_equal(whole[0], cut[0]) and len(whole[0]) > 3


@pytest.mark.parametrize("group_bytes", [1, 200, 16 << 20])
def test_order_of_repeated_null_and_outlying_ids(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(fingerprints, "GROUP_BYTES", group_bytes)
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 5, 5, 5, -2 ** 63, 2 ** 63 - 1, rnd.randint(0, 40)]), _prose(rnd, rnd.randint(1, 30))) for _ in range(90)]
    df = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], DOCS).repartition(3)
    hashes = [r[0] for r in spark.createDataFrame([(t,) for _, t in rows], "t string").selectExpr("xxhash64(t)").collect()]
    ordered = sorted(zip(rows, hashes), key=lambda r: (r[0][0] is None, -(r[0][0] or 0), r[1]))
    want = Counter()
    for k, ((i, t), _) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][0][1]
        want[i, hashlib.sha256((t[:len(t) - len(t) // 2] + after[:len(t) // 2]).encode()).hexdigest()] += 1
    got = fingerprints.compare_with_edits(df, np.arange(fingerprints.LEVELS)).collect()
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want


def test_fingerprints_of_few_null_and_repeated_rows(spark):
    make = lambda rows: spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], DOCS)
    assert fingerprints.compare_with_edits(make([])).collect() == []
    text = _prose(random.Random(1), 80)
    one = fingerprints.compare_with_edits(make([(4, text)])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert one[0]["edited_sha256"] == _brute_edits([(4, text)])[4][1]
    rows = [(None, text), (None, None), (7, text), (7, text), (7, "other words here"), (8, "")]
    got = fingerprints.compare_with_edits(make(rows)).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    assert len({r["fingerprint"] for r in got if r["n_chars"] == len(text)}) == 1
    assert {r["fingerprint"] for r in got if not r["n_chars"]} == {""}
