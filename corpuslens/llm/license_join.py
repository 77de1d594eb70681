"""License scan: an exact set-similarity join of text blocks with license templates.

Blocks are the lines and, for each template, windows of consecutive words, as many as the template has by ``containment``,
which go across line ends, so wrapped text is found; a window starts at each word that is one of the template's.
Tokens are ordered by how many words of the whole corpus they are (one counting pass over all texts, for
the templates' tokens; all others are rarer than any and can't match). A template whose share ``containment``
of distinct tokens must stand in a block has to share with it one of its ``n - need + 1`` rarest tokens (prefix
filter). Of the blocks that hold such a token, those with fewer of the template's words than needed go (length
filter), then those that lack the words by which the template's license differs from others; the rest is counted
exactly, rarest token first, and a block is left as soon as the remaining tokens can't make up for those that are missing
(positional filter). Templates that are phrases must stand consecutively: their rarest token fixes the
only place to look at.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows are scored one by one; a very long text is worked on alone;
other columns are ignored; an empty table gives an empty result. The templates are a parameter; their total
size is checked, as every task holds them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, _words

#: phrase -> label
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Statements and paragraphs that mark a license, as they are commonly written, and what a block must hold of them as it stands (one of the
#: phrases between | each), as other licenses are worded alike.
TEMPLATES = [
    ("mit", "Released under the MIT License.", ["mit"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["associated"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0.", ["apache", "2|v2"]),
    ("apache-2", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache", "license 2"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["noncommercial|non commercial"]),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license", "3|v3"]),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", ["gnu general public license"]),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", []),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["sharealike|share alike"]),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ["substantial portions"]),
    ("mit", 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.', ["noninfringement"]),
    ("apache-2", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', ["apache license", "2"]),
    ("apache-2", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied.', ["warranties or conditions of any kind"]),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["endorse or promote"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["mozilla public license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["with or without fee"]),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["unencumbered"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ["waived"]),
]
#: Templates that name no such words and have fewer distinct tokens than this need all of them.
SHORT = 10
#: Share of a template's words that a block must hold.
CONTAINMENT = 0.8
MAX_TEMPLATE_BYTES = 16 << 20
NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _words.words(data, np.array([0, len(data)]), _words.ALNUM)[0]


class Templates:
    """Phrases and templates with the tokens to look up first."""

    def __init__(self, docs: DataFrame, text_col: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple] | None = None, containment: float = CONTAINMENT):
        phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
        if sum(len(x) for x in [*phrases, *(t[1] for t in templates)]) > MAX_TEMPLATE_BYTES:
            raise ValueError("more templates than a task may hold: scan with parts of them and join the results")
        self.phrases = [(_hashes(p), label) for p, label in phrases.items() if len(_hashes(p))]
        own = [(label, _hashes(text), *(must or [[]])) for label, text, *must in templates if len(_hashes(text))]
        self.sets = [(np.unique(h), label) for label, h, _ in own]
        self.width = [math.ceil(len(h) / containment) for _, h, _ in own]
        #: for each template the groups of phrases of which a block must hold one each
        self.must = [[[_hashes(p) for p in group.split("|")] for group in must] for _, _, must in own]
        self.need = [len(s) if not must and len(s) < SHORT else math.ceil(containment * len(s)) for (s, _), must in zip(self.sets, self.must)]
        self.tokens = np.unique(np.concatenate([x for x, _ in [*self.phrases, *self.sets]] or [np.zeros(0, np.uint64)]))
        tokens = self.tokens

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(tokens), np.int64)
            for batch in batches:
                for _, _, data, at in _words.pieces(batch.column(0)):
                    own = _words.words(data, at, _words.ALNUM)[0]
                    where = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                    total += np.bincount(where[tokens[where] == own], minlength=len(tokens))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tokens))), pa.array(total)], names=["token", "n"])

        self.freq = np.zeros(len(tokens), np.int64)
        if len(tokens):
            for row in docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(_shared.lean(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():  # as many rows as the templates have tokens
                self.freq[row["token"]] = row["n"]
        #: tokens by rank: rarest first
        rank = np.empty(len(tokens), np.int64)
        rank[np.lexsort((tokens, self.freq))] = np.arange(len(tokens))
        self.rank = rank
        ranks = lambda h: rank[np.searchsorted(tokens, h)]
        self.phrase_key = [int(np.argmin(ranks(p))) for p, _ in self.phrases]
        self.set_ranks = [np.sort(ranks(s)) for s, _ in self.sets]


def _starts(hashed: np.ndarray, text_of: np.ndarray, phrase: np.ndarray, key: int = 0) -> np.ndarray:
    """Where all words of a phrase stand in one text; word key is looked up first."""
    first = np.flatnonzero(hashed == phrase[key]) - key
    first = first[(first >= 0) & (first + len(phrase) <= len(hashed))]
    for j, h in enumerate(phrase):
        first = first[hashed[first + j] == h]
    return first[text_of[first] == text_of[first + len(phrase) - 1]]


def _next(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first of sorted places from each position on, or one beyond any."""
    return np.append(places, np.iinfo(np.int64).max >> 1)[np.searchsorted(places, at)]


def _scan(t: Templates, column: pa.Array) -> Iterator[tuple]:
    for _, _, data, at in _words.pieces(column):
        hashed, start, _, bounds = _words.words(data, at, _words.ALNUM)
        n = len(bounds) - 1
        places: list[list[int]] = [[] for _ in range(n)]
        base: list[set[str]] = [set() for _ in range(n)]
        more: list[dict[str, float]] = [{} for _ in range(n)]
        text_of = np.repeat(np.arange(n), np.diff(bounds))
        for (phrase, label), key in zip(t.phrases, t.phrase_key):
            first = _starts(hashed, text_of, phrase, key)
            for text, s in zip(text_of[first], first):
                places[text].append(int(s - bounds[text]))
                base[text].add(label)
        if len(t.tokens) and len(hashed):
            where = np.minimum(np.searchsorted(t.tokens, hashed), len(t.tokens) - 1)
            known = np.flatnonzero(t.tokens[where] == hashed)
            rank = t.rank[where[known]]
            order = np.argsort(rank, kind="stable")
            spots = np.split(known[order], np.searchsorted(rank[order], np.arange(1, len(t.tokens))))  # of each rank, in order
            lines = np.flatnonzero(data == 10)
            line_of = np.searchsorted(lines, start) + text_of  # grows at every new line and every new text
            block = np.flatnonzero(np.diff(line_of, prepend=-1))
            block_end = np.append(block[1:], len(hashed))
            for (_, label), want, need, width, must in zip(t.sets, t.set_ranks, t.need, t.width, t.must):
                rare = np.sort(np.concatenate([spots[r] for r in want[: len(want) - need + 1]]))
                if not len(rare):
                    continue
                hit = np.sort(np.concatenate([spots[r] for r in want]))
                first = np.concatenate((hit, block))
                stop = np.concatenate((np.minimum(hit + width, bounds[text_of[hit] + 1]), block_end))
                keep = (_next(rare, first) < stop) & (np.searchsorted(hit, stop) - np.searchsorted(hit, first) >= need)
                first, stop = first[keep], stop[keep]
                for group in must:
                    keep = np.zeros(len(first), bool)
                    for phrase in group:
                        keep |= _next(_starts(hashed, text_of, phrase), first) + len(phrase) <= stop
                    first, stop = first[keep], stop[keep]
                common = np.zeros(len(first), np.int64)
                for left, r in zip(range(len(want) - 1, -1, -1), want):
                    common += _next(spots[r], first) < stop
                    keep = common + left >= need
                    first, stop, common = first[keep], stop[keep], common[keep]
                for text, c in zip(text_of[first].tolist(), common.tolist()):
                    more[text][label] = max(more[text].get(label, 0.0), c / len(want))
        for i in range(n):
            n_base = len(places[i])
            score = 1.0 if n_base else max(more[i].values(), default=0.0)
            yield int(bounds[i + 1] - bounds[i]), n_base, min(places[i], default=None), max(places[i], default=None), ",".join(sorted(base[i])), ",".join(sorted(base[i] | set(more[i]))), score


def scan(docs: DataFrame, templates: Templates, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its words, places and labels of phrases, all labels, and the best containment found."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*_scan(templates, batch.column(1)))) or [[]] * len(NAMES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(rows, TYPES))], names=["doc_id", *NAMES])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_shared.lean(run), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
