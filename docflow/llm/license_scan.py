"""License scans by patience alignment.

A template and a stretch of text are aligned on the words that each holds exactly
once: the longest increasing subsequence of these anchors stays, and the gaps
between them are aligned again in the same way, down to gaps without an anchor.
Equal words at both ends of a gap match at once. The share of the template's words
that match is its coverage; stretches at or above ``min_coverage`` are reported.

Where to align: a covered template shares that share of its words with the text, so
a text is looked at only for templates of which it has so many words (each as often as it stands in both).
Then every place of a template's word in the text says where the template would start. Starts
within half a template's length of each other that come from enough of its places
are aligned; so insertions of up to about a third of the template's words break nothing.
Of licenses that overlap, the one with the most matching words stays, of equals the one with the higher
coverage.

The work is per text and shuffles nothing; texts are encoded in batches and only
texts with enough hits are looked at word by word. Words are lower-cased, split at
white space, and stripped of punctuation at their ends.

Defined results: null and blank texts hold no license; a text that repeats a
license has a row for each place; rows that repeat are scanned each; templates
under three words are refused; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docflow.llm.arrow import lean, slices
from docflow.llm.spaced_seeds import CHUNK, word_hashes
from docflow.llm.text import pick

#: Notices and short licenses as their authors publish them.
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version 3 of the License, "
    "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the {0} for more details."
)
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": _BSD_START + _BSD_END,
    "BSD-3-Clause": (
        _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all "
        "present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "AGPL-3.0-notice": _GNU.format("GNU Affero General Public License"),
    "LGPL-3.0-notice": _GNU.format("GNU Lesser General Public License"),
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": _GNU.format("GNU General Public License"),
}
#: Words that a template has at least.
SHORTEST = 3
#: Texts whose words are counted at a time.
ROWS = 64


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, v in enumerate(values):
        pile = bisect_left(tops, v)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(k)
        else:
            tops[pile], at[pile] = v, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matching places of both, increasing in each."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_text, in_template = Counter(text[a0:a1]), Counter(template[b0:b1])
        place = {w: k for k, w in enumerate(template[b0:b1], b0) if in_template[w] == 1 and in_text[w] == 1}
        anchors = [(k, place[w]) for k, w in enumerate(text[a0:a1], a0) if w in place]
        anchors = [anchors[k] for k in increasing([b for _, b in anchors])]
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        gaps += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Scanner:
    """Templates, and the numbers of their words."""

    def __init__(self, templates: dict[str, str], min_coverage: float):
        self.names = list(templates)
        hashes, counts = word_hashes(pa.array(list(templates.values()), pa.string()))
        if len(counts) and counts.min() < SHORTEST:
            raise ValueError(f"a template needs {SHORTEST} words")
        ends = np.cumsum(counts)
        self.words = [hashes[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]
        #: Words of all templates in order, and how often each template has each.
        self.known, number = np.unique(hashes, return_inverse=True)
        self.times = np.zeros((len(counts), len(self.known)), np.int64)
        np.add.at(self.times, (np.repeat(np.arange(len(counts)), counts), number), 1)
        self.least = [max(1, math.ceil(min_coverage * n - 1e-9)) for n in counts.tolist()]
        self.places: list[dict[int, list[int]]] = []
        for words in self.words:
            own: dict[int, list[int]] = {}
            for k, w in enumerate(words):
                own.setdefault(w, []).append(k)
            self.places.append(own)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for those of no template."""
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        return np.where(self.known[at] == words, at, -1)

    def likely(self, numbers: np.ndarray, owner: np.ndarray, texts: int) -> list[tuple[int, int]]:
        """Text and template pairs that share enough words."""
        out = []
        kept = numbers >= 0
        number, owner = numbers[kept], owner[kept]
        for low in range(0, texts, ROWS):
            own = (owner >= low) & (owner < low + ROWS)
            have = np.bincount((owner[own] - low) * len(self.known) + number[own], minlength=ROWS * len(self.known)).reshape(ROWS, -1)
            for t, times in enumerate(self.times):
                shared = np.minimum(have[:, times > 0], times[times > 0]).sum(axis=1)
                out += [(low + int(k), t) for k in np.flatnonzero(shared >= self.least[t])]
        return sorted(out)

    def scan(self, words: np.ndarray, templates: list[int]) -> list[tuple[str, int, int, int, int]]:
        """``name, start, end, matched, size`` of the licenses in one text."""
        found = [x for t in templates for x in self._places_of(words, t)]
        # The most matching words first; what overlaps a better one goes.
        out: list[tuple[str, int, int, int, int]] = []
        for x in sorted(found, key=lambda x: (-x[3], -x[3] / x[4], x[1], x[0])):
            if all(x[2] <= y[1] or y[2] <= x[1] for y in out):
                out.append(x)
        return sorted(out, key=lambda x: (x[1], x[0]))

    def _places_of(self, words: np.ndarray, t: int):
        template, n = self.words[t], len(self.words[t])
        own = self.places[t]
        at = np.flatnonzero(np.isin(words, np.array(list(own), np.uint64)))
        hits = sorted((p - k, k) for p, w in zip(at.tolist(), words[at].tolist(), strict=True) for k in own[w])
        starts = [s for s, _ in hits]
        reach, done, i = n // 2 + 1, 0, 0
        while i < len(hits):
            j = bisect_right(starts, starts[i] + reach)
            if j - i < self.least[t] or len({k for _, k in hits[i:j]}) < self.least[t]:
                i += 1
                continue
            low, high = max(starts[i] - n // 4, done), min(starts[j - 1] + n + n // 4, len(words))
            pairs = align(words[low:high].tolist(), template)
            if len(pairs) >= self.least[t]:
                first, last = low + pairs[0][0], low + pairs[-1][0]
                yield self.names[t], first, last + 1, len(pairs), n
                done = last + 1
                # What starts before its end belongs to it.
                i = max(i + 1, bisect_right(starts, last - n // 4))
            else:
                i += 1


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, min_coverage: float = 0.8) -> DataFrame:
    """``id_col, license, start_word, end_word, matched_words, template_words, coverage`` of every license found."""
    own = pick(docs, _id=id_col, _text=text_col)
    scanner = Scanner(templates or TEMPLATES, min_coverage)

    def run(batches):
        for batch in batches:
            rows, found = [], []
            for lo, hi in slices(batch.column(1), CHUNK):
                words, counts = word_hashes(batch.column(1).slice(lo, hi - lo))
                ends = np.cumsum(counts)
                likely = scanner.likely(scanner.numbers(words), np.repeat(np.arange(hi - lo), counts), hi - lo)
                for k, pairs in groupby(likely, key=lambda x: x[0]):
                    for license_ in scanner.scan(words[ends[k] - counts[k] : ends[k]], [t for _, t in pairs]):
                        rows.append(lo + k)
                        found.append(license_)
            columns = list(zip(*found, strict=True)) if found else [()] * 5
            kinds = [pa.string(), *[pa.int64()] * 4]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
            share = pa.array([m / n for _, _, _, m, n in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *arrays, share], ["_id", "license", "start_word", "end_word", "matched_words", "template_words", "coverage"])

    kind = own.schema["_id"].dataType.simpleString()
    out = own.mapInArrow(lean(run), f"_id {kind}, license string, start_word bigint, end_word bigint, matched_words bigint, template_words bigint, coverage double")
    return out.withColumnRenamed("_id", id_col)
