"""License scans: normalised text against licence templates, by the Dice coefficient of their sets of word bigrams.

Normalising lower-cases A-Z, takes words of letters, digits and bytes from 0x80 on, and leaves out lines that begin with `copyright`
and a `c`, a sign or a year. What is compared are windows: runs of words of a document, wherever they begin and end, across lines and blank lines. With A
the window's and T the template's distinct bigrams, they match when 2 |A and T| >= threshold * (|A| + |T|).

Sizes prune first: an overlap is at least threshold * |T| / (2 - threshold), so shorter documents are out, and a window is at most
(2 - threshold) / threshold times as long as the template. All bigrams of a slice are looked up in one sorted table of the templates'
bigrams; only (document, template) pairs with enough hits within such a length go on. There the exact coefficients of all windows
that begin with a hit are taken by running sums (a bigram counts where it stands first in a window), the best window is a match, and
what is left on both sides is searched in turn. Of windows of several templates that overlap, the one with most common bigrams stays.

Templates are full texts and customary notices, few and of fixed size; they go out once to each executor. Texts that aren't among them,
such as AGPL-3.0 in full, can be given as a parameter.

Null and empty texts and texts of one word match nothing. Repeated rows get equal results; a null doc_id stays null. Ties go to the
higher coefficient, then to the first template in the list. Very long texts are taken whole. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import store
from tessera.llm.textkernel import U64, distinct, mix, prefix_hash, slices, span_hash, text_buffers

THRESHOLD = 0.9

_WARRANTY_MIT = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Licence, and a template of its text or of a notice that names it (fixed values: public licence texts and customary notices).
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY_MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_TAIL}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY_MIT.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + " For more information, please refer to <https://unlicense.org>"),
    ("BSL-1.0", 'Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

#: Licences whose full texts stand in the folder beside this module, as their publishers give them.
FULL = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")


def templates() -> tuple[tuple[str, str], ...]:
    """All templates: the full texts, then the shorter ones and the notices."""
    folder = resources.files(__package__) / "licence_texts"
    return (*((name, (folder / f"{name}.txt").read_text(encoding="utf-8")) for name in FULL), *NOTICES)


_inside = np.zeros(256, dtype=bool)
_inside[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Bigrams:
    """Bigrams of a batch of texts in order: hashes, and the document, first line and last line of each."""

    def __init__(self, texts: pa.Array, notices: bool = False):
        data, at = text_buffers(texts)
        n = len(data)
        inside = _inside[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        start = np.flatnonzero(inside & (edge[:n] | ~np.concatenate(([False], inside[:-1])))) if n else np.zeros(0, np.int64)
        end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1 if n else start
        words = span_hash(prefix_hash(data), start, end)
        breaks = np.flatnonzero(data == 10)
        line_start = np.sort(np.concatenate([breaks + 1, at[:-1]]))
        line_doc = np.sort(np.concatenate([np.searchsorted(at, breaks, side="right") - 1, np.arange(len(at) - 1)]))
        line = np.searchsorted(line_start, start, side="right") - 1
        if not notices and len(line):
            head = np.concatenate(([True], line[1:] != line[:-1]))
            notice = np.zeros(len(line_start), dtype=bool)
            second = np.minimum(np.flatnonzero(head) + 1, len(words) - 1)
            digit = (data[start[second]] >= 48) & (data[start[second]] <= 57)
            notice[line[head]] = (words[head] == _word("copyright")) & ((words[second] == _word("c")) | (words[second] == _word("©")) | digit)
            kept = ~notice[line]
            words, line = words[kept], line[kept]
        doc = line_doc[line]
        pair = doc[1:] == doc[:-1]
        number = line - np.searchsorted(line_doc, np.arange(len(at) - 1))[doc] if len(line) else line
        self.hash = mix(words[:-1] * U64(0x9DDFEA08EB382D69) + words[1:])[pair] if len(words) > 1 else np.zeros(0, U64)
        self.doc, self.first_line, self.last_line = doc[:-1][pair], number[:-1][pair], number[1:][pair]


def _word(text: str) -> np.uint64:
    data = np.frombuffer(text.encode(), np.uint8)
    return span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0]


class Templates:
    """The bigrams of all templates in one sorted table, with the templates that hold each."""

    def __init__(self, given: tuple[tuple[str, str], ...], threshold: float):
        self.names = [name for name, _ in given]
        whole = [Bigrams(pa.array([text])).hash for _, text in given]
        self.sets = [distinct(x) for x in whole]
        self.size = np.array([len(x) for x in self.sets], dtype=np.int64)
        self.threshold = threshold
        self.longest = np.ceil(np.array([len(x) for x in whole]) * (2 - threshold) / threshold).astype(np.int64)
        held = np.concatenate([*self.sets, np.zeros(0, U64)])
        owner = np.repeat(np.arange(len(given)), self.size)
        order = np.argsort(held, kind="stable")
        held, self.owner = held[order], owner[order]
        self.table = distinct(held)
        self.first = np.append(np.searchsorted(held, self.table), len(held))
        self.least = np.maximum(1, np.ceil(self.size * threshold / (2 - threshold) - 1e-9))

    def matches(self, hashes: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(document, template, first and last bigram, Dice coefficient) of the windows that match, those of one document apart from each other."""
        if not len(hashes) or not len(self.table):
            return []
        place = np.minimum(np.searchsorted(self.table, hashes), len(self.table) - 1)
        hit = np.flatnonzero(self.table[place] == hashes)
        place = place[hit]
        count = self.first[place + 1] - self.first[place]
        spread = np.repeat(self.first[place] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        pair, at = doc[np.repeat(hit, count)] * len(self.names) + self.owner[spread], np.repeat(hit, count)
        order = np.argsort(pair, kind="stable")
        pair, at = pair[order], at[order]
        begin = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(pair))
        found: list[tuple[int, int, int, int, int, float]] = []
        for k in np.flatnonzero(end - begin >= self.least[pair[begin] % len(self.names)]).tolist():
            d, t = divmod(int(pair[begin[k]]), len(self.names))
            found += [(d, t, *x) for x in self._windows(hashes, at[begin[k] : end[k]], int(np.searchsorted(doc, d, side="right")), t)]
        out: list[tuple[int, int, int, int, float]] = []
        taken: list[tuple[int, int]] = []
        for d, t, a, b, _, dice in sorted(found, key=lambda x: (-x[4], -x[5], x[1], x[2])):
            k = bisect.bisect(taken, (b, b))
            if not k or taken[k - 1][1] < a:
                taken.insert(k, (a, b))
                out.append((d, t, a, b, dice))
        return out

    def _windows(self, hashes: np.ndarray, hits: np.ndarray, stop: int, t: int) -> list[tuple[int, int, int, float]]:
        """(first, last, common bigrams, coefficient) of a document's windows; hits: the places of the template's bigrams."""
        longest, found = int(self.longest[t]), []
        enough = hits[np.searchsorted(hits, hits + longest) - np.arange(len(hits)) >= self.least[t]]
        at = 0
        while at < len(enough):
            low = int(enough[at])
            # a window that begins up to `longest` further on ends within this stretch
            high = min(stop, low + 2 * longest)
            stretch = hashes[low:high]
            order = np.argsort(stretch, kind="stable")
            before = np.full(len(stretch), -1)
            same = stretch[order][1:] == stretch[order][:-1]
            before[order[1:][same]] = order[:-1][same]
            hit = np.zeros(len(stretch), dtype=bool)
            hit[hits[np.searchsorted(hits, low) : np.searchsorted(hits, high)] - low] = True
            starts = enough[at : np.searchsorted(enough, low + longest + 1)] - low
            own: list[tuple[int, int, int, float]] = []
            self._search(before, hit, starts, 0, len(stretch), t, own)
            found += [(low + a, low + b, common, dice) for a, b, common, dice in own]
            at = int(np.searchsorted(enough, max(low + longest + 1, *(low + x[1] + 1 for x in own), 0)))
        return found

    def _search(self, before: np.ndarray, hit: np.ndarray, starts: np.ndarray, low: int, high: int, t: int, found: list) -> None:
        """Adds the windows between low and high that begin at `starts`, the best first, then those on its two sides. before: where each
        bigram stood last; in a window it counts once."""
        best = (0.0, 0, 0, 0)
        for a in starts[np.searchsorted(starts, low) : np.searchsorted(starts, high)].tolist():
            end = min(high, a + int(self.longest[t]))
            new = before[a:end] < a
            common = np.cumsum(new & hit[a:end])
            if common[-1] < self.least[t]:
                continue
            dice = 2.0 * common / (np.cumsum(new) + self.size[t])
            b = int(np.argmax(dice))
            if dice[b] > best[0] + 1e-12:
                best = (float(dice[b]), a, a + b, int(common[b]))
        dice, a, b, common = best
        if dice >= self.threshold:
            found.append((a, b, common, dice))
            self._search(before, hit, starts, low, a, t, found)
            self._search(before, hit, starts, b + 1, high, t, found)


MATCH = "struct<license:string,first_line:long,last_line:long,dice:double>"


def scan(docs: DataFrame, given: tuple[tuple[str, str], ...] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and matches: the windows that match a template (all of templates() unless given), in the order of their lines, which count from 0."""
    spark = docs.sparkSession
    store.bounded(spark)
    known = spark.sparkContext.broadcast(Templates(templates() if given is None else given, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        fields = [("license", pa.string()), ("first_line", pa.int64()), ("last_line", pa.int64()), ("dice", pa.float64())]
        for batch in slices(batches, "text"):
            bigrams = Bigrams(batch.column(1))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for d, t, a, b, dice in sorted(table.matches(bigrams.hash, bigrams.doc), key=lambda x: x[2]):
                found[d].append({"license": table.names[t], "first_line": int(bigrams.first_line[a]), "last_line": int(bigrams.last_line[b]), "dice": dice})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct(fields)))], names=["doc_id", "matches"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id long, matches array<{MATCH}>")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many windows match, and the best one (the highest coefficient, then the first line)."""
    found = scan(store.documents(spark, sf_dir))
    best = F.get(F.array_sort("matches", lambda a, b: F.when(a["dice"] != b["dice"], F.signum(b["dice"] - a["dice"])).otherwise(a["first_line"] - b["first_line"]).cast("int")), F.lit(0))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), best["license"].alias("license"), best["first_line"].alias("first_line"), best["last_line"].alias("last_line"), best["dice"].alias("dice"))
