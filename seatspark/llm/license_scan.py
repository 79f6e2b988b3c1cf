"""License scan by a positional rare-token index over licence templates.

The index lists, for each template word, the templates and places that hold it.
A file's words of highest IDF (rare among templates) are looked up; each
occurrence says where the template would begin in the file, and the postings
are intersected by that place. Places that enough different words agree on are
candidates; a template is found if its mandatory key phrases stand in the file
near that place and none of them is negated. The plain phrases of ``PHRASES``
are looked for in every file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ready
from .textops import ALNUM, byte_values, text_slices, utf8, word_hashes

#: Phrases that are labels by themselves.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Fixed values: (label, template text, mandatory key phrases); sentences of the public licence notices.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the Software), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software", ["permission is hereby granted free of charge", "without restriction"]),
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
     ["distribute this software for any purpose with or without fee is hereby granted"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at",
     ["apache license version 2"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission.",
     ["may be used to endorse or promote products derived from this software"]),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License",
     ["gnu general public license", "version 3"]),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.",
     ["gnu general public license version 3"]),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation; either version 2 of the License",
     ["gnu general public license", "version 2"]),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
     ["gnu lesser general public license", "version 2 1"]),
    ("lgpl-3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
     ["gnu lesser general public license", "version 3"]),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
     ["gnu affero general public license", "version 3"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
     ["mozilla public license v 2"]),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
     "License 2.0", ["eclipse public license 2 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
     "modify, publish, use, compile, sell, or distribute this software",
     ["free and unencumbered software released into the public domain"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
     "to this work.", ["waived all copyright and related or neighboring rights"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ["cc by sa"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
     ["attribution sharealike"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
     ["attribution noncommercial"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
     ["creative commons attribution 4 0"]),
]
#: Label and its identifiers in tag lines.
IDENTIFIERS = [
    ("mit", ["MIT"]), ("isc", ["ISC"]), ("apache-2", ["Apache-2.0"]), ("bsd", ["BSD-2-Clause"]), ("bsd-3", ["BSD-3-Clause"]),
    ("gpl-2", ["GPL-2.0-only", "GPL-2.0-or-later"]), ("gpl-3", ["GPL-3.0-only", "GPL-3.0-or-later"]),
    ("lgpl-2.1", ["LGPL-2.1-only", "LGPL-2.1-or-later"]), ("lgpl-3", ["LGPL-3.0-only", "LGPL-3.0-or-later"]),
    ("agpl-3", ["AGPL-3.0-only", "AGPL-3.0-or-later"]), ("mpl-2", ["MPL-2.0"]), ("epl-2", ["EPL-2.0"]),
    ("unlicense", ["Unlicense"]), ("cc0", ["CC0-1.0"]), ("cc-by", ["CC-BY-4.0"]), ("cc-by-sa", ["CC-BY-SA-4.0"]),
    ("cc-by-nc", ["CC-BY-NC-4.0"]),
]
#: Label and the path of its deed.
DEEDS = [("cc-by", "licenses/by/4.0"), ("cc-by-sa", "licenses/by-sa/4.0"), ("cc-by-nc", "licenses/by-nc/4.0"),
         ("cc0", "publicdomain/zero/1.0")]


def _plain(text: str) -> str:
    return " ".join(re.findall(r"[a-z0-9]+", text.lower()))


def _templates() -> list[tuple[str, str, list[str]]]:
    """Notices, tag lines and addresses of deeds; the last two are mandatory as a whole."""
    short = [(label, f"SPDX-License-Identifier: {x}") for label, names in IDENTIFIERS for x in names]
    short += [(label, f"https://creativecommons.org/{path}") for label, path in DEEDS]
    return NOTICES + [(label, text, [_plain(text.removeprefix("https://"))]) for label, text in short]


TEMPLATES = _templates()

#: A key phrase that one of these words stands before, at most NEGATION_SPAN words away, is no statement of a licence.
NEGATIONS, NEGATION_SPAN = ("not", "never", "neither", "nor"), 5

RARE_WORDS = 4  # words of highest IDF that must agree on a place, in a template (or all, if fewer)
SLACK = 2  # words that may be put in or left out before a rare word
_VALUES = byte_values(ALNUM)


def _hashes(text: str) -> np.ndarray:
    data, offsets = utf8(pa.array([text], pa.string()))
    return word_hashes(data, offsets, _VALUES)[0]


def find_phrase(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the phrase's words stand one after the other."""
    at = np.flatnonzero(words[:max(0, len(words) - len(phrase) + 1)] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[words[at + k] == phrase[k]]
    return at


def stated(words: np.ndarray, phrase: np.ndarray, negations: np.ndarray) -> bool:
    """Whether the phrase stands somewhere without a negation shortly before it."""
    return any(not np.isin(words[max(0, p - NEGATION_SPAN):p], negations).any() for p in find_phrase(words, phrase).tolist())


@dataclass
class LicenceIndex:
    labels: list[str]
    lengths: np.ndarray
    keys: list[list[np.ndarray]]
    needed: np.ndarray  # rare words of each template that must agree
    terms: np.ndarray  # sorted hashes of the rare words
    post_at: np.ndarray
    templates: np.ndarray  # postings
    places: np.ndarray
    maybe: np.ndarray
    phrases: list[tuple[np.ndarray, str]]
    phrase_starts: np.ndarray
    negations: np.ndarray


def build_index(templates=TEMPLATES, phrases=PHRASES, rare: int = RARE_WORDS) -> LicenceIndex:
    """Index of the rare words of each template, by IDF among the templates."""
    texts = [_hashes(t) for _, t, _ in templates]
    words, df = np.unique(np.concatenate([np.unique(t) for t in texts]), return_counts=True)
    posts = []
    needed = []
    for k, t in enumerate(texts):
        own = np.unique(t)
        chosen = own[np.lexsort((own, df[np.searchsorted(words, own)]))][:2 * rare]  # highest IDF first
        needed.append(-(-2 * len(chosen) // 3))  # two thirds of them
        posts += [(w, k, p) for p, w in enumerate(t.tolist()) if w in set(chosen.tolist())]
    posts.sort()
    h = np.array([w for w, _, _ in posts], np.uint64)
    terms = np.unique(h)
    maybe = np.zeros(65536, bool)
    found = [(_hashes(p), label) for p, label in phrases]
    starts = np.array([p[0] for p, _ in found], np.uint64)
    maybe[(np.concatenate([terms, starts]) & np.uint64(65535)).astype(np.int64)] = True
    return LicenceIndex([k for k, _, _ in templates], np.array([len(t) for t in texts]),
                        [[_hashes(p) for p in keys] for _, _, keys in templates], np.array(needed), terms,
                        np.append(np.searchsorted(h, terms), len(h)), np.array([k for _, k, _ in posts]),
                        np.array([p for _, _, p in posts]), maybe, found, starts, _hashes(" ".join(NEGATIONS)))


def scan_words(index: LicenceIndex, words: np.ndarray, hit: np.ndarray):
    """(label, place, share of rare words) of the templates in one file; ``hit``: places of likely index words."""
    w = words[hit]
    term = np.minimum(np.searchsorted(index.terms, w), len(index.terms) - 1)
    good = index.terms[term] == w
    term, place = term[good], hit[good]
    if not len(term):
        return []
    count = index.post_at[term + 1] - index.post_at[term]
    ends = np.cumsum(count)
    at = np.arange(int(ends[-1])) - np.repeat(ends - count - index.post_at[term], count)
    template, begins = index.templates[at], np.repeat(place, count) - index.places[at]
    posting = at
    # places within SLACK of one another count as one beginning
    order = np.lexsort((begins, template))
    template, begins, posting = template[order], begins[order], posting[order]
    group = np.cumsum(np.concatenate([[0], (template[1:] != template[:-1]) | (np.diff(begins) > SLACK)]))
    pairs = np.unique(np.stack([group, posting], 1), axis=0)
    distinct = np.bincount(pairs[:, 0])
    first = np.searchsorted(group, np.arange(len(distinct)))
    last = np.searchsorted(group, np.arange(len(distinct)), "right") - 1
    out = []
    for g in np.flatnonzero(distinct >= index.needed[template[first]]).tolist():
        k = int(template[first[g]])
        low = max(0, int(begins[first[g]]) - SLACK)
        near = words[low:int(begins[last[g]]) + int(index.lengths[k]) + SLACK + 1]
        # words before the template's beginning may negate its first phrase
        lead = min(low, NEGATION_SPAN)
        if all(stated(words[low - lead:low + len(near)], key, index.negations) for key in index.keys[k]):
            total = int((index.templates == k).sum())
            out.append((index.labels[k], low, min(1.0, distinct[g] / total)))
    return out


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licences(docs: DataFrame, index: LicenceIndex | None = None) -> DataFrame:
    """doc_id and the licences found in each document, n_words, and the plain phrases' places.

    Words are runs of a-z (A-Z folded), digits and non-ASCII characters. n_base
    counts the places of the plain phrases; first_word and last_word are their
    smallest and largest beginning (null if none); base_labels and labels are
    distinct, sorted and joined by commas (empty if none); labels also has those
    of the templates found. score is 1 with a plain phrase, else the largest
    share of a found template's rare words, else 0. Null or empty texts have no
    words; null and repeated doc_ids are scanned like others.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(index or build_index())
    names = ["doc_id"] + [f.split()[0] for f in FOUND.split(", ")]

    def scan(batches):
        ix = shared.value
        for batch in batches:
            rows = []
            for _, _, data, offsets in text_slices(batch.column(1)):
                words, bounds = word_hashes(data, offsets, _VALUES)
                hits = np.flatnonzero(ix.maybe[(words & np.uint64(65535)).astype(np.int64)])
                hits = hits[np.isin(words[hits], ix.terms) | np.isin(words[hits], ix.phrase_starts)]
                edges = np.searchsorted(hits, bounds)
                for a, b, x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), edges[:-1].tolist(), edges[1:].tolist()):
                    if x == y:
                        rows.append((b - a, 0, None, None, "", "", 0.0))
                        continue
                    own, hit = words[a:b], hits[x:y] - a
                    base, places = set(), []
                    for phrase, label in ix.phrases:
                        if len(at := find_phrase(own, phrase)):
                            base.add(label)
                            places += at.tolist()
                    more = scan_words(ix, own, hit)
                    rows.append((b - a, len(places), min(places, default=None), max(places, default=None),
                                 ",".join(sorted(base)), ",".join(sorted(base | {k for k, _, _ in more})),
                                 1.0 if places else max((s for _, _, s in more), default=0.0)))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    return ready(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, " + FOUND)
