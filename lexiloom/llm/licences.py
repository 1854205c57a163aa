"""Licence scans with a generalised suffix automaton of licence words.

The templates and phrases below become one automaton over words; it does not grow with the corpus. Each text streams
through it once, giving at every word the longest run ending there that stands in some template. Runs that can't be
extended to the right are matches; those long enough are chained in text and template order into spans, and a span
that covers enough of its template gives the template's label.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_names, lean_batches

# The phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Openings of common public licences and notices, and their labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
]

#: Words that a match needs to be chained, the widest gap between chained matches, and the share of its template that a span must cover.
LEAST_MATCH, WIDEST_GAP, LEAST_COVER = 3, 8, 0.7

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of the text after A-Z are lower-cased; on UTF-8 bytes, as all bytes of other characters are word bytes."""
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


class SuffixAutomaton:
    """Generalised suffix automaton over word ids; root is state 0."""

    def __init__(self, templates: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        self.whole: list[int] = []
        for n, words in enumerate(templates):
            last = 0
            for at, w in enumerate(words):
                last = self.extend(last, w)
                self.ends[last].add((n, at))
            self.whole.append(last)
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.length) - 1

    def split(self, p: int, w: int) -> int:
        """The state for the longest string of p followed by w, cut off its class if that holds longer ones."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self.state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self.split(last, w)
        new, p = self.state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self.split(p, w)
        return new


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> None:
        known = [(label, words_of(p)) for p, label in phrases.items()] + [(label, words_of(t)) for label, t in templates]
        self.labels = [label for label, _ in known]
        self.sizes = [len(w) for _, w in known]
        self.n_phrases = len(phrases)
        self.ids: dict[bytes, int] = {}
        for _, words in known:
            for w in words:
                self.ids.setdefault(w, len(self.ids))
        self.machine = m = SuffixAutomaton([[self.ids[w] for w in words] for _, words in known])
        self.phrases_at: list[list[int]] = []  # phrases that end the longest string of the state
        whole = {m.whole[p]: p for p in range(self.n_phrases)}
        for s in range(len(m.length)):
            found, t = [], s
            while t > 0:
                if t in whole:
                    found.append(whole[t])
                t = m.link[t]
            self.phrases_at.append(found)

    def scan(self, text: str | None) -> tuple:
        """(n_words, base places as (start, phrase), {template: chains}, see ``chain``)."""
        words, get = words_of(text), self.ids.get
        m, least = self.machine, LEAST_MATCH
        step, link, length = m.next, m.link, m.length
        places, matches = [], defaultdict(list)
        s = run = 0
        ids = [get(w, -1) for w in words]
        ids.append(-1)
        for i, w in enumerate(ids):
            if w < 0 and not run:
                continue
            before, was = s, run
            if w < 0:
                s = run = 0
            else:
                while s and w not in step[s]:
                    s = link[s]
                    run = length[s]
                if w in step[s]:
                    s, run = step[s][w], run + 1
                else:
                    run = 0
                for p in self.phrases_at[s]:
                    if run >= self.sizes[p]:
                        places.append((i + 1 - self.sizes[p], p))
            if was >= least and run <= was:  # the run before could not be extended
                for t, end in m.ends[before]:
                    matches[t].append((i - was, end - was + 1, was))
        return len(words), places, {t: self.chain(found) for t, found in matches.items()}

    @staticmethod
    def chain(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Chains of (text start, template start, words) as (first word, last word, words matched), the best ones that don't overlap, in text order.

        Inside a chain both starts rise, gaps stay narrow, overlaps count once. Of equal chains the earlier one counts.
        """
        matches.sort()
        best: list[tuple[int, int]] = []  # words, first word of the chain
        first = 0
        for n, (at, of, size) in enumerate(matches):
            most, begin = size, at
            while matches[first][0] + matches[first][2] + WIDEST_GAP < at and first < n:
                first += 1
            for k in range(first, n):
                x, y, z = matches[k]
                over = max(0, x + z - at, y + z - of)
                if x < at and y < of and of - (y + z) <= WIDEST_GAP and over < size and best[k][0] + size - over > most:
                    most, begin = best[k][0] + size - over, best[k][1]
            best.append((most, begin))
        out: list[tuple[int, int, int]] = []  # disjoint, in text order
        for k in sorted(range(len(matches)), key=lambda k: (-best[k][0], k)):
            (words, begin), last = best[k], matches[k][0] + matches[k][2] - 1
            place = bisect.bisect_left(out, (begin,))
            if (not place or out[place - 1][1] < begin) and (place == len(out) or last < out[place][0]):
                out.insert(place, (begin, last, words))
        return out

    def report(self, text: str | None) -> tuple:
        n, places, spans = self.scan(text)
        base = {self.labels[p] for _, p in places}
        cover = [(min(1.0, words / self.sizes[t]), a, b, t) for t, own in spans.items() for a, b, words in own]
        kept = sorted((a, b, self.labels[t]) for c, a, b, t in cover if c >= LEAST_COVER and t >= self.n_phrases)
        starts = [at for at, _ in places]
        score = max([*(c for c, *_ in cover), 1.0 if places else 0.0, 0.0])
        labels = base | {label for *_, label in kept}
        return (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [f"{a}-{b}:{label}" for a, b, label in kept])


_scanners: dict[str, Scanner] = {}


def scanner(known: tuple) -> Scanner:
    """The worker's scanner of (phrases, templates), built once."""
    name = repr(known)
    if name not in _scanners:
        _scanners.clear()
        _scanners[name] = Scanner(*known)
    return _scanners[name]


REPORT = "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string, labels: string, score: double, spans: array<string>>"


def scan_licences(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``docs`` plus n_words, n_base, first_word, last_word, base_labels, labels, score and spans (``first-last:label``).

    Null texts count as empty: 0 words, no labels (empty strings), score 0. first_word and last_word are null without a
    base place. A template that stands several times has a span for each. The score is the largest share of a template that a span
    covers, 1 with a base place. A very long text is one list of words in one task, about ten times its size. Null ids and
    repeated rows pass through; an empty table gives an empty result. Input columns named like results are replaced, all others stay.
    """
    lean_batches(docs.sparkSession)
    known = (dict(phrases), list(templates))

    @F.pandas_udf(REPORT)
    def report(texts: pd.Series) -> pd.DataFrame:
        own = scanner(known)
        found = [own.report(t) for t in texts]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        frame = pd.DataFrame(found, columns=names)
        return frame.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64"})

    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    docs = docs.drop(*made)
    (own,) = free_names(docs, "_report")
    return docs.withColumn(own, report(F.col("text"))).select(*docs.columns, *[F.col(f"{own}.{c}").alias(c) for c in made])
