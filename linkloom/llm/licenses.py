"""License scan with a generalised suffix automaton of licence words.

The words of all templates go into one automaton (built once in the driver: its size follows from
the templates, not from the data).  A file's words are streamed through it, which gives at each word
the longest match that ends there (the matching statistics).  Right-maximal matches of at least
``LEAST_MATCH`` words are placed on their templates and chained, in order and with small gaps, into
spans; a template whose chain covers enough of it gives its label.  Base phrases are templates too:
a phrase ends at a word if its state is the current one or reached from it by suffix links, and the
match is long enough.

A word outside the templates resets the match, so only runs of template words are streamed one by one.

Edge cases: null and empty texts have no words, no labels, score 0; very long texts are streamed whole; ties between chains go to the
longer, then the earlier one; repeated rows give repeated rows; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import mapped, row_groups

# Base phrases with their labels, and the public wording of common licences.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "bsd": [
        "licensed under the bsd license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "gpl": [
        "licensed under the gnu general public license",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "licensed under cc by 4.0", "licensed under cc by sa 4.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: Words of the shortest match that is chained; a long template also counts from this covered share on.
LEAST_MATCH, LEAST_SHARE, MOST_GAP = 4, 0.6, 12
#: A-Z to lower case; every other ASCII byte that is no digit or letter separates words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Automaton:
    """Generalised suffix automaton over word ids; ends[s]: (template, last word) of each place of state s."""

    def __init__(self, templates: list[list[bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.lengths = [len(t) for t in templates]
        self.last: list[list[int]] = []  # the state after each word of each template
        for words in templates:
            state, path = 0, []
            for w in words:
                state = self._extend(state, self.vocabulary.setdefault(w, len(self.vocabulary)))
                path.append(state)
            self.last.append(path)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for t, words in enumerate(templates):
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][self.vocabulary[w]]
                s = state
                while s > 0:  # templates are short; every suffix state learns this place
                    self.ends[s].append((t, i))
                    s = self.link[s]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length), self.link.append(link), self.next.append(following)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A state for the strings of q that p can be extended to, if q also has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and c not in self.next[last]:
            self.next[last][c] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, self.next[last][c], c)
        return new

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(state, longest match) after each id."""
        state = length = 0
        following, link, longest = self.next, self.link, self.length
        for c in ids:
            while state and c not in following[state]:
                state = link[state]
                length = longest[state]
            if c in following[state]:
                state, length = following[state][c], length + 1
            yield state, length


class Scanner:
    def __init__(self) -> None:
        self.phrases = [words_of(p.encode()) for p in BASE]
        self.phrase_labels = list(BASE.values())
        pairs = [(label, words_of(t.encode())) for label, texts in TEMPLATES.items() for t in texts]
        self.labels = [label for label, _ in pairs]
        self.templates = [w for _, w in pairs]
        self.automaton = Automaton(self.templates + self.phrases)
        n = len(self.templates)
        # phrases that end wherever a state is reached, with the match length that it takes
        self.ending = [sorted({(len(self.phrases[t - n]), t - n) for t, i in places if t >= n and i == len(self.phrases[t - n]) - 1}) for places in self.automaton.ends]
        self.ending = [[x for x in e if x[0] <= self.automaton.length[s]] for s, e in enumerate(self.ending)]
        # a state whose strings end with a phrase, inside any template
        by_state: dict[int, list[tuple[int, int]]] = {}
        for k, p in enumerate(self.phrases):
            state = 0
            for w in p:
                state = self.automaton.next[state][self.automaton.vocabulary[w]]
            by_state.setdefault(state, []).append((len(p), k))
        for s in range(1, len(self.automaton.next)):
            found, a = [], s
            while a > 0:
                found += by_state.get(a, [])
                a = self.automaton.link[a]
            self.ending[s] = found
        self.places = [[(t, i) for t, i in e if t < n] for e in self.automaton.ends]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[float, str, int, int]]]:
        """Words; base places (phrase, start); spans (covered share, label, first word, after the last)."""
        words = words_of(text)
        ids = np.array(list(map(self.automaton.vocabulary.get, words, repeat(-1))), np.int32)
        known = np.concatenate(([False], ids >= 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
        base: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []  # (start, words, state), right-maximal
        for a, b in edges[edges[:, 1] - edges[:, 0] >= 2].tolist():
            before, state_before = 0, 0
            for i, (state, length) in enumerate(self.automaton.stream(ids[a:b].tolist()), a):
                if length >= 2:
                    base += [(k, i - m + 1) for m, k in self.ending[state] if m <= length]
                if before >= LEAST_MATCH and length <= before:
                    matches.append((i - before, before, state_before))
                before, state_before = length, state
            if before >= LEAST_MATCH:
                matches.append((b - before, before, state_before))
        return len(words), base, self.chain(matches) if matches else []

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[float, str, int, int]]:
        """Joins matches that follow each other in file and template alike; keeps chains that cover enough."""
        open_: dict[int, list[int]] = {}  # template -> [covered, first word, file end, template end]
        spans: list[tuple[float, str, int, int]] = []

        def close(t: int) -> None:
            covered, first, end, _ = open_.pop(t)
            share = covered / len(self.templates[t])
            if share >= LEAST_SHARE:
                spans.append((share, self.labels[t], first, end))

        for start, n, state in matches:
            placed: dict[int, int] = {}
            for t, i in self.places[state]:
                prior = open_.get(t)
                if t not in placed or (prior and placed[t] - n < prior[3] <= i + 1 - n):
                    placed[t] = i + 1
            for t, end in placed.items():
                prior = open_.get(t)
                if prior:
                    over = max(0, prior[2] - start, prior[3] - (end - n))  # words the two matches share
                    if over < n and start - prior[2] <= MOST_GAP and end - n - prior[3] <= MOST_GAP and end > prior[3]:
                        open_[t] = [prior[0] + n - over, prior[1], start + n, end]
                        continue
                    if prior[0] / len(self.templates[t]) >= n / len(self.templates[t]) and start < prior[2]:
                        continue
                    close(t)
                open_[t] = [n, start, start + n, end]
        for t in list(open_):
            close(t)
        return sorted(spans, key=lambda s: (s[2], -s[0], s[1]))


@cache
def scanner() -> Scanner:
    return Scanner()


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,share:double,first:long,after:long>>"


def scan(documents: DataFrame) -> DataFrame:
    """One row per document: base places, labels of phrases and of covered templates, score, spans."""
    span = pa.struct([("label", pa.string()), ("share", pa.float64()), ("first", pa.int64()), ("after", pa.int64())])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for batch, texts in row_groups(batches):
            rows = []
            for text in texts:
                n, base, spans = s.scan(text)
                starts = [i for _, i in base]
                named = {s.phrase_labels[k] for k, _ in base}
                score = max([x[0] for x in spans], default=0.0)
                rows.append((n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(named)), ",".join(sorted(named | {x[1] for x in spans})), min(1.0, max(score, 1.0 if base else 0.0)), [{"label": b, "share": min(a, 1.0), "first": c, "after": d} for a, b, c, d in spans]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=names)

    return mapped(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)
