"""License scans: winnowed fingerprints find candidates, banded alignment measures them.

Templates and documents are split into words (runs of a-z, 0-9 and non-ASCII characters after A-Z is lower-cased). Of every
`window` hashes of `gram` words in a row the smallest is picked, so any `gram + window - 1` words that a document shares
with a template share a picked hash. Templates of fewer words are looked up by
all their grams, picked or not. An inverted index from picked hashes to template places turns each hit into a diagonal
(document word less template word); each hit outside the matches found so far is a candidate. The document's words around
it that are in no match of that template yet are aligned with it inside the band (longest common subsequence), and `coverage` is the share of the
template's words that stand in order in the document. Candidates below `least_coverage` are dropped, and of overlapping ones the most
matched words win, then the template that is listed first.

The templates are a fixed list of notices and short licenses, without the bodies of the long ones (Apache, GPL, LGPL,
AGPL, MPL, Creative Commons), so the index that goes to the tasks is bounded by the list. Documents are only scanned,
row by row; nothing is shuffled. Null and empty texts match nothing. A document may match several templates in
different places and gives a row for each; repeated rows each give theirs. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import lower_ascii, mix, slices, text_bytes, word_hashes, word_spans
from netspark.llm.decontaminate import IS_WORD, Membership

SLICE = 8 << 20

#: Names after SPDX, and the notices and texts that these licenses ask to be kept with a work.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced without prior written permission."),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("AGPL-3.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("LGPL-3.0", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("Proprietary", "All rights reserved."),
]


@dataclass(frozen=True)
class LicenseParams:
    gram: int = 3
    window: int = 3
    band: int = 8
    least_coverage: float = 0.8
    templates: list[tuple[str, str]] = field(default_factory=lambda: TEMPLATES)


def words_with_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    low = lower_ascii(data)
    starts, ends, text = word_spans(IS_WORD[low], offsets)
    return word_hashes(low, starts, ends), starts, ends, np.searchsorted(text, np.arange(len(offsets)))


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    n = max(len(words) - gram + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(gram):
        out = mix((out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15))
    return out


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of each window, the last of equals; all of a list that is shorter than a window by its smallest."""
    if len(hashes) == 0:
        return np.zeros(0, np.int64)
    size = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, size)
    return np.unique(np.arange(len(views)) + size - 1 - views[:, ::-1].argmin(axis=1))


class Index:
    """Templates as words, and where each picked hash stands in them."""

    def __init__(self, params: LicenseParams):
        self.params, self.names, self.words = params, [n for n, _ in params.templates], []
        places, short = [], [np.zeros(0, np.uint64)]
        for number, (_, text) in enumerate(params.templates):
            words = words_with_places(*text_bytes(pa.array([text])))[0]
            self.words.append(words)
            hashes = gram_hashes(words, params.gram)
            if len(words) < params.gram + params.window - 1:
                short.append(hashes)
                picked = np.arange(len(hashes))
            else:
                picked = winnowed(hashes, params.window)
            places += [(int(hashes[p]), number, int(p)) for p in picked]
        places.sort()
        self.key = np.array([p[0] for p in places], np.uint64)
        self.at = np.array([p[1:] for p in places], np.int64).reshape(-1, 2)
        self.member = Membership(np.unique(self.key))
        self.short = Membership(np.unique(np.concatenate(short)))

    def scan(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, template, first word, end word, matched words) of all accepted matches in a run of documents."""
        p = self.params
        hashes = gram_hashes(words, p.gram)
        hit = np.flatnonzero(self.member.places(hashes) >= 0)
        if len(hit) == 0:
            return []
        found = []
        doc = np.searchsorted(first, hit, "right") - 1
        for d in np.unique(doc).tolist():
            begin, end = int(first[d]), int(first[d + 1])
            some = hit[(doc == d) & (hit + p.gram <= end)] - begin
            if len(some):
                own = words[begin:end]
                picked = winnowed(hashes[begin : max(begin, end - p.gram + 1)], p.window)
                some = some[np.isin(some, picked) | (self.short.places(hashes[begin + some]) >= 0)]
                found += [(d, *m) for m in self._document(own, some, hashes[begin:end])]
        return found

    def _document(self, words: np.ndarray, hits: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, int, int]]:
        p, candidates = self.params, set()
        low, high = np.searchsorted(self.key, hashes[hits], "left"), np.searchsorted(self.key, hashes[hits], "right")
        for at, a, b in zip(hits.tolist(), low.tolist(), high.tolist(), strict=True):
            for number, place in self.at[a:b].tolist():
                candidates.add((number, at - place, at))
        matches, tried = [], set()
        spans: dict[int, list[tuple[int, int]]] = {}
        # A hit inside a span of its template belongs to it; any other is aligned with the words between the spans around it.
        for number, diagonal, at in sorted(candidates):
            own = spans.setdefault(number, [])
            k = bisect.bisect_right(own, at, key=lambda span: span[0])
            low, high = own[k - 1][1] if k else 0, own[k][0] if k < len(own) else len(words)
            if at < low or (number, diagonal, low, high) in tried:
                continue
            tried.add((number, diagonal, low, high))
            least = p.least_coverage * len(self.words[number])
            if min(high, diagonal + len(self.words[number]) + p.band) - max(low, diagonal - p.band) < least:
                continue
            start, stop, matched = aligned(self.words[number], words, diagonal, p.band, low, high)
            if matched >= least:
                matches.append((number, start, stop, matched))
                own.insert(k, (start, stop))
        chosen: list[tuple[int, int, int, int]] = []
        for match in sorted(matches, key=lambda m: (-m[3], m[0], m[1])):
            if all(match[2] <= c[1] or c[2] <= match[1] for c in chosen):
                chosen.append(match)
        return chosen


def aligned(template: np.ndarray, words: np.ndarray, diagonal: int, band: int, low: int = 0, high: int | None = None) -> tuple[int, int, int]:
    """(first word, end word, matched words): the longest common subsequence of the template and the document's words, both
    taken within `band` words of the diagonal, with the shortest span of those that end first. Of the document's words those
    from `low` to before `high` count."""
    width, high = 2 * band + 1, len(words) if high is None else high
    # Cell k of row i stands for document word i + diagonal - band + k; values are (matched, -start) packed to compare.
    best = np.zeros(width, np.int64)
    begin = np.full(width, -1, np.int64)
    top, span = 0, (0, 0)
    for i, word in enumerate(template.tolist()):
        place = i + diagonal - band + np.arange(width)
        inside = (place >= low) & (place < high)
        same = inside & (np.where(inside, words[np.clip(place, 0, len(words) - 1)], 0) == word)
        # The row above in document terms is one cell to the right; the diagonal neighbour is the same cell.
        skip, skip_begin = np.append(best[1:], 0), np.append(begin[1:], -1)
        value = np.where(same, best + 1, skip)
        start = np.where(same, np.where(best > 0, begin, place), skip_begin)
        for k in range(1, width):
            if value[k - 1] > value[k] or (value[k - 1] == value[k] and start[k - 1] > start[k]):
                value[k], start[k] = value[k - 1], start[k - 1]
        best, begin = value, start
        for k in np.flatnonzero(same).tolist():
            if best[k] > top:
                top, span = int(best[k]), (int(begin[k]), int(place[k]) + 1)
    return (*span, top)


SCHEMA = "license string, template int, matched_words int, template_words int, coverage double, first_word int, end_word int, start int, stop int"


def scan(docs: DataFrame, params: LicenseParams = LicenseParams()) -> DataFrame:
    """doc_id, license, template, matched_words, template_words, coverage, first_word, end_word and start, stop (bytes of UTF-8) of every match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(params)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for part in slices(batches, SLICE):
            data, offsets = text_bytes(part.column(1))
            words, starts, ends, first = words_with_places(data, offsets)
            rows, at = [], []
            for d, number, a, b, matched in index.scan(words, first):
                size, begin = len(index.words[number]), int(first[d])
                base = int(offsets[d])
                at.append(d)
                rows.append((index.names[number], number, matched, size, matched / size, a, b, int(starts[begin + a]) - base, int(ends[begin + b - 1]) - base))
            if rows:
                kinds = [pa.string(), *[pa.int32()] * 3, pa.float64(), *[pa.int32()] * 4]
                columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *columns], names=["doc_id", *names])

    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
