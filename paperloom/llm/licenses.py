"""License scans: spans of a text against license templates by Dice's coefficient over word bigrams.

A template and a span are normalised alike (lower case, all but letters and digits to blanks) and
compared as sets of word bigrams. Spans are all runs of words, over lines and paragraphs. The closest
span of a template starts and ends with a bigram of it, as any other bigram at an edge only adds to
the size; so spans are sought from each such bigram on, up to the size at which no coefficient can
reach the threshold: one of t needs sizes within a factor of (2 - t) / t of each other, and as many
bigrams of the template as the lower bound, which rules out most texts at once.
"""

from __future__ import annotations

import bisect
import heapq
import pkgutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import slices

THRESHOLD = 0.75

_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
)


def _gnu(name: str, version: str, work: str = "program") -> str:
    return (
        f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the "
        f"License, or (at your option) any later version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


def _full(name: str) -> tuple[str, str]:
    return name, pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()


# Public license notices and license texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", f"{_BSD_CONDITIONS} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("GPL-3.0", _gnu("GNU General Public License", "3")),
    ("GPL-2.0", _gnu("GNU General Public License", "2")),
    ("LGPL-3.0", _gnu("GNU Lesser General Public License", "3")),
    ("LGPL-2.1", _gnu("GNU Lesser General Public License", "2.1", "library")),
    ("AGPL-3.0", _gnu("GNU Affero General Public License", "3")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    *map(_full, ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")),
)

_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 or c == 10 else 32) for c in range(256))

SCHEMA = "doc_id bigint, n_found bigint, license string, dice double, matches array<struct<license: string, dice: double, first_line: bigint, last_line: bigint, shared: bigint>>"


def normalise(text: str) -> bytes:
    """Lower case, all but letters, digits and line feeds to blanks (bytes of UTF-8 above 127 are letters)."""
    return text.encode().translate(_TABLE)


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:], strict=False))


class Scanner:
    def __init__(self, templates: tuple = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.templates = [(name, bigrams(normalise(text).split())) for name, text in templates]
        self.number = {pair: k for k, pair in enumerate(sorted(set().union(*(own for _, own in self.templates))))}
        self.holds = np.zeros((len(self.number), len(self.templates)), bool)
        for i, (_, own) in enumerate(self.templates):
            self.holds[[self.number[pair] for pair in own], i] = True
        self.sizes = self.holds.sum(axis=0)
        # a span of n bigrams of a template has n or more, so 2n / (n + size) bounds its coefficient
        self.needed = threshold * self.sizes / (2 - threshold) - 1e-9

    def best(self, pairs: set) -> tuple[str, float] | None:
        """The template closest to a set of bigrams, the first by name and place among equals."""
        found = []
        for i, (name, own) in enumerate(self.templates):
            if own and (dice := 2 * len(pairs & own) / (len(pairs) + len(own))) >= self.threshold:
                found.append((-dice, name, i))
        return (min(found)[1], -min(found)[0]) if found else None

    def scan(self, text: str | None) -> list[dict]:
        """Matches of a text in order. The closest span of any template is taken first, the longest
        among equals, then the closest ones of what is left before and after it."""
        split = [line.split() for line in normalise(text or "").split(b"\n")]
        words = [w for line in split for w in line]
        get = self.number.get
        known = np.array([get(pair, -1) for pair in zip(words, words[1:], strict=False)], np.int64)
        counts = self.holds[np.unique(known[known >= 0])].sum(axis=0)
        able = np.flatnonzero((counts >= self.needed) & (counts > 0))
        if not len(able):
            return []
        spans = _Spans(words)
        hits = {int(i): (known >= 0) & self.holds[known, i] for i in able}
        heap: list[tuple] = []

        def offer(i: int, start: int, stop: int) -> None:
            found = spans.closest(start, stop, hits[i], int(self.sizes[i]), self.threshold)
            if found:
                dice, end = found
                heapq.heappush(heap, (-dice, start - end, self.templates[i][0], i, start, end))

        for i, hit in hits.items():
            so_far = np.concatenate([[0], np.cumsum(hit)])
            starts = np.flatnonzero(hit)
            for start in starts[so_far[spans.next[starts]] - so_far[starts] >= self.needed[i]].tolist():
                offer(i, start, len(known))
        line = np.repeat(np.arange(len(split)), list(map(len, split)))
        taken: list[tuple[int, int]] = []
        out = []
        while heap:
            dice, _, name, i, start, end = heapq.heappop(heap)
            place = bisect.bisect(taken, (start, end))
            if place and taken[place - 1][1] + 1 >= start:
                continue
            if place < len(taken) and taken[place][0] <= end + 1:
                offer(i, start, taken[place][0] - 1)
                continue
            low = taken[place - 1][1] + 2 if place else 0
            high = taken[place][0] - 1 if place < len(taken) else len(known)
            start, end = spans.widened(start, end, low, high, hits[i])
            taken.insert(place, (start, end))
            shared = len(np.unique(known[start : end + 1][hits[i][start : end + 1]]))
            out.append((start, {"license": name, "dice": -dice, "first_line": int(line[start]), "last_line": int(line[end + 1]), "shared": shared}))
        return [match for _, match in sorted(out, key=lambda m: m[0])]


class _Spans:
    """The bigrams of a text with the places before and after that have the same one."""

    def __init__(self, words: list[bytes]):
        codes: dict[tuple, int] = {}
        code = np.array([codes.setdefault(pair, len(codes)) for pair in zip(words, words[1:], strict=False)], np.int64)
        order = np.argsort(code, kind="stable")
        same = code[order[1:]] == code[order[:-1]]
        self.before = np.full(len(code), -1)
        self.before[order[1:][same]] = order[:-1][same]
        self.next = np.full(len(code), len(code))
        self.next[order[:-1][same]] = order[1:][same]

    def closest(self, start: int, stop: int, hit: np.ndarray, own: int, threshold: float) -> tuple[float, int] | None:
        """The coefficient and the last bigram of the closest span from ``start`` on and before
        ``stop`` for a template of ``own`` bigrams, the shortest among equals. A span that has its
        first bigram again is no closer than the one from there on, so it is left out; so the lengths
        tried for one bigram of a template add up to the text at most."""
        stop, most = min(stop, int(self.next[start])), own * (2 - threshold) / threshold
        best, at, size, shared = None, start, 0, 0
        while at < stop and size <= most:
            end = min(stop, at + int(most) + 1)
            new = self.before[at:end] < start
            sizes, common = size + np.cumsum(new), shared + np.cumsum(new & hit[at:end])
            dice = 2 * common / (sizes + own)
            k = int(np.argmax(dice))
            if dice[k] >= threshold and (best is None or dice[k] > best[0]):
                best = (float(dice[k]), at + k)
            at, size, shared = end, int(sizes[-1]), int(common[-1])
        return best

    def widened(self, start: int, end: int, low: int, high: int, hit: np.ndarray) -> tuple[int, int]:
        """The span with the bigrams of the template around it that it has already, from ``low`` on and
        before ``high``; they change no coefficient."""
        while end + 1 < high and hit[end + 1] and self.before[end + 1] >= start:
            end += 1
        while start > low and hit[start - 1] and self.next[start - 1] <= end:
            start -= 1
        return start, end


#: Templates that reserve rights and license nothing: such a match counts if there is no other.
NOTICES = ("Proprietary",)


def leading(matches: list[dict]) -> dict:
    """The match that names the license of a text: the one with most bigrams of its template, then the
    highest coefficient, the first among equals; a bare notice only without any other."""
    return max(matches, key=lambda m: (m["license"] not in NOTICES, m["shared"], m["dice"]))


def scan(documents: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``documents`` (columns doc_id and text; others are ignored): the number
    of matched spans, the leading license (see ``leading``) with its coefficient, and all matches with
    their lines, from 0, and the number of bigrams they share with the template. Without a match, or for a null or empty text, n_found is 0 and
    license null. Equal rows get equal results; a null doc_id is passed on; no rows give none."""
    sent = documents.sparkSession.sparkContext.broadcast((templates, threshold))  # a fixed list

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*sent.value)
        kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int64()), ("last_line", pa.int64()), ("shared", pa.int64())]))
        for batch in batches:
            for part in slices(batch):
                found = [scanner.scan(t) for t in part.column("text").to_pylist()]
                best = [leading(f) if f else {"license": None, "dice": None} for f in found]
                columns = [pa.array([len(f) for f in found], pa.int64()), pa.array([b["license"] for b in best], pa.string()), pa.array([b["dice"] for b in best], pa.float64()), pa.array(found, kind)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_found", "license", "dice", "matches"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)
