"""Licence scan: Dice coefficient over word bigrams against licence templates.

A text is compared as a whole, by paragraphs and by lines, and by windows of
words that may begin and end anywhere.  Two texts of m and n bigrams reach at
most 2 min(m, n) / (m + n), so a unit meets only the templates whose size allows
the threshold, and a window is looked for only where bigrams of a template lie
close enough together.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate, chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsmill.llm.common import id_and_text, ship, table

THRESHOLD = 0.8
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
_PLAIN = bytes.maketrans(
    PUNCTUATION.encode() + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(PUNCTUATION) + b"abcdefghijklmnopqrstuvwxyz"
)

#: Common notices and short licences, as their publishers word them.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License.",
    "MIT notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
    "THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO '
    "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
    "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
    "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
    "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
    "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
    "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def plain_words(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, ASCII punctuation as white space."""
    return text.translate(_PLAIN).split()


def bigrams(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:]))


def sizes_allow(m: int, n: int, threshold: float) -> bool:
    """Whether texts of m and n bigrams can reach ``threshold``, all of the smaller one's being shared."""
    return 2 * min(m, n) >= threshold * (m + n)


def units(lines: list[list[bytes]], blank: list[bool]) -> Iterator[tuple[str, int, int]]:
    """(kind, first line, line after the last) of the whole text, its paragraphs if more than one, and its lines if more than one."""
    yield "text", 0, len(lines)
    if len(lines) == 1:
        return
    start, paragraphs = None, []
    for k, empty in enumerate([*blank, True]):
        if start is None and not empty:
            start = k
        elif start is not None and empty:
            paragraphs.append((start, k))
            start = None
    if len(paragraphs) > 1:
        for a, b in paragraphs:
            yield "paragraph", a, b
    for k in range(len(lines)):
        yield "line", k, k + 1


def windows(places: list[int], grams: list, template: Counter, size: int, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(first bigram, last bigram, n_shared) of windows that reach the threshold, from left to right and none overlapping.

    ``places`` are the positions in ``grams`` of bigrams of the template.  A window that
    reaches it does so without what is not the template's at its ends, so all
    windows from place to place are all that matter.  Of those that overlap the
    one that ends first, the best is taken, the first and shortest of equals; so no
    stretch between the windows taken reaches the threshold.
    """
    need = next((s for s in range(1, size + 1) if sizes_allow(s, size, threshold)), size + 1)
    if len(places) < need or (Counter(grams[p] for p in places) & template).total() < need:
        return
    i = 0
    while i + need <= len(places):
        first_end, best = None, None
        while i + need <= len(places) and (first_end is None or places[i] <= first_end):
            start, shared, seen = places[i], 0, Counter()
            span = places[i + need - 1] - start + 1
            i += 1
            if span > size and not sizes_allow(span, size, threshold):
                continue
            for end in islice(places, i - 1, None):
                m = end - start + 1
                if m > size and not sizes_allow(m, size, threshold):
                    break
                g = grams[end]
                seen[g] += 1
                shared += seen[g] <= template[g]
                if 2 * shared >= threshold * (m + size):
                    first_end = end if first_end is None else min(first_end, end)
                    if best is None or shared * (best[1] - best[0] + 1 + size) > best[2] * (m + size):
                        best = start, end, shared
        if best is not None:
            yield best
            i = bisect_left(places, best[1] + 1)


def licence_matches(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, licence, unit, first_line, n_shared, n_unit, n_template): each template that a unit of a text reaches.

    Units are the text, its paragraphs and its lines.  A passage that reaches a
    template elsewhere - over several paragraphs or lines, or inside one - is a unit
    "window"; its first_line is that of its first word.
    The Dice coefficient is 2 n_shared / (n_unit + n_template), over bigrams with
    their repeats.  Units and templates of fewer than two words have none and
    match nothing; so do null and empty texts.  Each row is scanned, also with a
    null or repeated id.  Other columns are not read.
    """
    sized = []
    for name, text in (TEMPLATES if templates is None else templates).items():
        grams = bigrams(plain_words(text.encode()))
        if grams:
            sized.append((grams.total(), name, grams))
    owners = defaultdict(list)
    for k, (*_, grams) in enumerate(sized):
        for g in grams:
            owners[g].append(k)

    def matches(text: str) -> Iterator[tuple]:
        raw = text.encode().split(b"\n")
        lines = [plain_words(x) for x in raw]
        words = list(chain.from_iterable(lines))
        hits = [k for k, g in enumerate(zip(words, islice(words, 1, None))) if g in owners]
        if not hits:
            return
        first = [0, *accumulate(map(len, lines))]
        grams = list(zip(words, words[1:]))
        told = defaultdict(list)  # word ranges of the units that reach a template
        for kind, line, after in units(lines, [not x.strip() for x in raw]):
            a, b = first[line], first[after]
            n = b - a - 1
            may = [(k, t) for k, t in enumerate(sized) if sizes_allow(n, t[0], threshold)] if n > 0 else []
            if not may or (at := bisect_left(hits, a)) == len(hits) or hits[at] >= b - 1:
                continue
            own = Counter(grams[a : b - 1])
            for k, (size, name, template) in may:
                shared = (own & template).total()
                if 2 * shared >= threshold * (n + size):
                    told[k].append((a, b - 1))
                    yield name, kind, line, shared, n, size
        places = defaultdict(list)
        for h in hits:
            for k in owners[grams[h]]:
                places[k].append(h)
        for k, where in places.items():
            size, name, template = sized[k]
            found = list(windows(where, grams, template, size, threshold))
            # a unit tells of one passage, the one it has most of
            known = set()
            for a, b in told[k] if found else ():
                near = range(max(0, bisect_left(found, (a,)) - 1), bisect_left(found, (b,)))
                known.add(max(near, key=lambda w: min(b, found[w][1] + 1) - max(a, found[w][0]), default=None))
            for w, (start, end, shared) in enumerate(found):
                if w not in known:
                    line = bisect_left(first, start + 1) - 1
                    yield name, "window", line, shared, end - start + 1, size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                out += [(doc_id, *m) for m in matches(text.as_py() or "")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MATCH)], schema=_MATCH)

    ship(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, "doc_id long, licence string, unit string, first_line long, n_shared long, n_unit long, n_template long")


_MATCH = pa.schema([("doc_id", pa.int64()), ("licence", pa.string()), ("unit", pa.string()), *((c, pa.int64()) for c in ("first_line", "n_shared", "n_unit", "n_template"))])


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_matches(table(spark, sf_dir, "documents"))
