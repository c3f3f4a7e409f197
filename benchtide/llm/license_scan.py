"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment verifies them.

Texts and templates are sets of five-word shingles. Templates are put into classes by their number of shingles, rounded
up to a power of two s. A text is cut into windows of 2*s shingles that begin every s shingles, so a template that stands
in a text lies whole in one window. BANDS minima of one row each are compared: a window that holds 0.8 of a template of n
shingles (s/2 < n <= s) has a Jaccard similarity of at least 0.8n / (2s + 0.2n) >= 0.19 with it, so one band of 64 at
least agrees with a probability of 1 - (1 - 0.19)^64 > 0.999998. Window minima come from minima of blocks, each class
from the one below, and a table of 2^16 bits drops nearly all windows before the exact look-up.

A window that shares a band is verified: the share of the template's shingles in the window. A template counts in a text
if a window holds CONTAINMENT of it or more.

Defined results: null and empty texts, and texts of fewer than five words, hold no license. Templates of fewer than five
words are refused. Repeated rows give repeated rows. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 64

#: A warranty clause that several licenses share but for who speaks.
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Short notices and opening passages of common licenses, and the full texts of short ones, as their projects publish them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + _BSD_END,
    "bsd-3-clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    "isc-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

_WORD = np.zeros(256, np.uint8)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, *range(0x80, 0x100)]] = 1


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of each text in order, and where each text's begin. Words are runs of letters, digits and underscores, A-Z in lower case."""
    data, at = C.flat(texts)
    data = C._LOWER[data]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    start, end = C.runs(_WORD[data], at)
    h, first = C.hashes(data, start, end), np.searchsorted(start, at)
    n = max(0, len(h) - SHINGLE + 1)
    g = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        g = C.mix(g * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n])
    many = np.maximum(np.diff(first) - SHINGLE + 1, 0)
    keep = np.repeat(first[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return g[keep], np.concatenate([[0], np.cumsum(many)])


class Band(NamedTuple):
    """Of one band and class: the sieve by the top 16 bits, the templates' minima in order, and whose they are."""

    sieve: np.ndarray
    least: np.ndarray
    template: np.ndarray


class Templates:
    def __init__(self, templates: Mapping[str, str], bands: int = BANDS, containment: float = CONTAINMENT):
        self.names, self.containment, self.bands = list(templates), containment, bands
        g, first = shingles(C.texts_of(pa.array(list(templates.values()), pa.large_string())))
        self.sets = [np.unique(g[a:b]) for a, b in zip(first, first[1:], strict=False)]
        if not all(map(len, self.sets)):
            raise ValueError(f"a template needs {SHINGLE} words")
        self.times = np.random.default_rng(11).integers(0, 2**63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        size = np.array([1 << (len(s) - 1).bit_length() for s in self.sets])
        self.classes: dict[int, list[Band]] = {}
        for s in sorted(set(size.tolist())):
            own = np.flatnonzero(size == s)
            self.classes[s] = []
            for k in range(bands):
                least = np.array([self.rank(self.sets[t], k).min() for t in own], np.uint32)
                order = np.argsort(least, kind="stable")
                sieve = np.zeros(1 << 16, bool)
                sieve[least >> np.uint32(16)] = True
                self.classes[s].append(Band(sieve, least[order], own[order]))

    def rank(self, x: np.ndarray, band: int) -> np.ndarray:
        """The order of shingles in a band: their hashes are mixed already, so the high half of a product with an odd number makes another order."""
        return (x * self.times[band] >> np.uint64(32)).astype(np.uint32)

    def candidates(self, g: np.ndarray, first: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, template, window) with a band in common; windows of s shingles are two blocks, from block number `window` of the class on."""
        found: set[tuple[int, int, int]] = set()
        if not len(g):
            return found
        levels, count, s = [], np.diff(first), 1
        while s <= max(self.classes):  # blocks of s shingles, the last of a text may be shorter; the same in all bands
            at = np.concatenate([[0], np.cumsum(count)])
            half = (count + 1) // 2
            to = np.cumsum(half) - half
            left = np.repeat(at[:-1] - 2 * to, half) + 2 * np.arange(half.sum())
            levels.append((s, at, at[1:][count > 0] - 1, left, np.minimum(left + 1, np.repeat(at[1:], half) - 1)))
            count, s = half, 2 * s
        for k in range(self.bands):
            block = self.rank(g, k)
            for s, at, last, left, right in levels:
                if s in self.classes:
                    pair = np.minimum(block, np.append(block[1:], np.uint32(0xFFFFFFFF)))
                    pair[last] = block[last]
                    band = self.classes[s][k]
                    for w in np.flatnonzero(band.sieve[pair >> np.uint32(16)]):
                        for x in range(int(np.searchsorted(band.least, pair[w])), len(band.least)):
                            if band.least[x] != pair[w]:
                                break
                            text = int(np.searchsorted(at, w, "right")) - 1
                            found.add((text, int(band.template[x]), int(w - at[text])))
                block = np.minimum(block[left], block[right])
        return found

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int]]:
        """(text, template, containment, first shingle of the window) of the best window of each pair that reaches the containment."""
        g, first = shingles(texts)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for text, template, window in self.candidates(g, first):
            want = self.sets[template]
            s = 1 << (len(want) - 1).bit_length()
            a = first[text] + window * s
            share = float(np.isin(want, g[a : min(a + 2 * s, first[text + 1])]).mean())
            if share >= self.containment and (share, -window * s) > best.get((text, template), (0.0, 0)):
                best[text, template] = (share, -window * s)
        for (text, template), (share, at) in sorted(best.items()):
            yield text, template, share, -at


def _scan(spread):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spread.value
        for batch in C.blocks(batches, most=1 << 20):
            rows = list(known.scan(C.texts_of(batch["text"])))
            if rows:
                t, license, share, at = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(t)), pa.array([known.names[x] for x in license]), pa.array(share, pa.float64()), pa.array(at, pa.int64())], ["doc_id", "license", "containment", "first_word"])

    return scan


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, text: str = "text", doc_id: str = "doc_id", containment: float = CONTAINMENT) -> DataFrame:
    """One row for each license that a text holds: doc_id, license, containment, first_word (where its best window begins). Nothing is shuffled; the templates are broadcast, they are a fixed list."""
    known = docs.sparkSession.sparkContext.broadcast(Templates(templates, containment=containment))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scan(known), "doc_id long, license string, containment double, first_word long")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"))
