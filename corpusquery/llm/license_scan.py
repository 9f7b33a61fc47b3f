"""License texts found in documents by patience alignment with templates."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusquery.llm.arrow import append_columns, own_columns, strings
from corpusquery.llm.decontaminate import words_of

# Notices and texts of public licenses, as they are commonly printed.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        'and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies."
    ),
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version."
    ),
}

# Share of the words of a template that a match has.
MIN_COVERAGE = 0.8

# Words that templates which differ in no more of them are told apart by.
NEIGHBOUR_WORDS = 2


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k:
            before[i] = piles[k - 1]
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def patience_align(text: list, template: list) -> list[tuple[int, int]]:
    """Pairs of equal words, rising on both sides.

    Words that occur once in both parts are anchors, of which the longest
    increasing subsequence is kept; the gaps between anchors are aligned in the
    same way.  Equal words at the ends of a gap are matched first.
    """
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if in_text[w] == 1}
        common = [(i, place[w]) for i, w in enumerate(template[c:d], c) if in_template[w] == 1 and w in place]
        chosen = [common[k] for k in longest_increasing([p for _, p in common])]
        for i, p in chosen:
            pairs.append((p, i))
        if chosen:
            ends = [(c - 1, a - 1), *chosen, (d, b)]
            gaps += [(p + 1, q, i + 1, j) for (i, p), (j, q) in zip(ends, ends[1:])]
    return sorted(pairs)


class Scanner:
    """Best match of every template in the words of a text."""

    def __init__(self, templates: dict[str, str], min_coverage: float):
        self.templates = {n: words_of(t) for n, t in templates.items()}
        self.counts = {n: Counter(t) for n, t in self.templates.items()}
        self.vocabulary = set().union(*self.templates.values())
        self.min_coverage = min_coverage
        self.required = {n: self._telling(n, lambda own, other: own - other) for n in self.templates}
        self.foreign = {n: self._telling(n, lambda own, other: other - own) for n in self.templates}

    def _telling(self, name: str, differ) -> set[bytes]:
        """Words that tell a template from those that would pass as it."""
        own, out = self.counts[name], set()
        for other, counts in self.counts.items():
            shared = (own & counts).total()
            near = counts.total() - shared <= NEIGHBOUR_WORDS
            if other != name and near and shared >= self.min_coverage * own.total():
                out |= set(differ(own, counts))
        return out

    def scan(self, words: list[bytes]) -> list[dict]:
        if not self.vocabulary.intersection(words):
            return []
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.vocabulary:
                places[w].append(i)
        found = []
        for name, template in self.templates.items():
            shared = sum(min(n, len(places.get(w, ()))) for w, n in self.counts[name].items())
            if template and shared >= self.min_coverage * len(template):
                best = self._best(name, words, places)
                if best[0] >= self.min_coverage * len(template):
                    matched, start, end = best
                    found.append(
                        {
                            "license": name,
                            "matched": matched,
                            "template_words": len(template),
                            "coverage": matched / len(template),
                            "first_word": start,
                            "end_word": end,
                        }
                    )
        found.sort(key=lambda f: (-f["coverage"], -f["template_words"], f["license"]))
        return found

    def _best(self, name: str, words: list[bytes], places) -> tuple[int, int, int]:
        """Most matched words and their span, the first of equal ones.

        A match misses at most a fifth of the template, so it holds one of the
        words at that many places plus one.  Each occurrence of the words that
        are rarest in the text gives a tight window, in which a neighbouring copy
        cannot disturb, and some of them a wide one, for insertions.  A match has
        the words that tell the template from its neighbours and none of theirs.
        """
        template = self.templates[name]
        size = len(template)
        slack = size // 2 + 8
        spare = size - int(-(-self.min_coverage * size // 1)) + 1
        rarest = sorted(range(size), key=lambda k: (len(places.get(template[k], ())), k))[:spare]
        starts = sorted({p - k for k in rarest for p in places.get(template[k], ())})
        best, done = (0, 0, 0), None
        for at in starts:
            windows = [(max(0, at), min(len(words), at + size))]
            if done is None or at - done > slack // 4:
                done = at  # later windows hold what those up to there would
                windows.append((max(0, at - slack), min(len(words), at + size + slack)))
            for lo, hi in windows:
                if lo >= hi or words[lo:hi] == template:
                    pairs = [(k, k) for k in range(hi - lo)]
                else:
                    pairs = patience_align(words[lo:hi], template)
                if len(pairs) <= best[0]:
                    continue
                first, end = lo + pairs[0][0], lo + pairs[-1][0] + 1
                matched = {template[k] for _, k in pairs}
                if self.required[name] <= matched and not self.foreign[name].intersection(words[first:end]):
                    best = len(pairs), first, end
            if best[0] == size:
                break
        return best


_DDL = (
    "n_words bigint, licenses array<struct<license:string,matched:bigint,template_words:bigint,"
    "coverage:double,first_word:bigint,end_word:bigint>>"
)


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE
) -> DataFrame:
    """Add ``n_words`` and ``licenses``, the templates that a ``text`` holds, to documents.

    A template is found if its patience alignment with some passage of the
    text covers at least ``min_coverage`` of its words.  ``licenses`` has the
    best passage of each such template: words matched, words of the template,
    their quotient and the span of words in the text.  It is ordered by coverage,
    then longer templates first, then names.

    A null or empty text has no words and no licenses.  Repeated rows are
    scanned alike and all returned.  Other columns stay, but those named like a
    result are replaced; the text is dropped.
    """
    templates = TEMPLATES if templates is None else templates

    def make():
        scanner = Scanner(templates, min_coverage)

        def columns(batch):
            texts = [words_of(t) for t in strings(batch.column("text"))]
            return [[len(w) for w in texts], [scanner.scan(w) for w in texts]]

        return columns

    kept, own = own_columns(docs, {"n_words", "licenses", "text"})
    packed = docs.select(own.alias("own"), F.col("text").alias("text"))
    found = append_columns(packed, "text", _DDL, make, drop=("text",))
    return found.select(*[F.col("own").getField(c).alias(c) for c in kept], "n_words", "licenses")
