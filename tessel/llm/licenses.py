"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Templates are grouped by length. For a group whose longest template has T shingles of five words, a
text's windows have 1.5 T shingles and begin every T / 2, so any stretch of T lies in one of them.
A window that holds the share `percent` of a template has a similarity to it of at least a known
least value, and the number of bands follows from that: the chance that no band meets is at most
`miss`. Retrieved pairs are verified by the exact share of the template's shingles in the window.

Windows without any shingle of a template cannot match one and are not hashed, which changes no result.

Overlapping windows that match the same template are one stretch. A stretch is parted into copies:
once a copy holds enough of the template, a shingle that comes more often than the template has it
begins the next one; what is left behind the last copy and is too little for one belongs to it.

Defined results: null and empty texts match nothing; texts of fewer than five words are one
shingle; templates without words are left out; typographic quotes, dashes and marks part words as
ASCII marks do; repeated rows match each; a null doc_id is reported as null; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import raw_texts
from tessel.llm.decontam import FOLD
from tessel.llm.superminhash import GOLDEN, WordHashes, mix, shingle_hashes

SHINGLE = 5
MATCH = "doc_id long, license string, first_word long, n_words long, percent int"

#: Notices and grants of common public licences, in their published wording.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT-warranty": (
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "BSD-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
}

_hashes = WordHashes()
#: Quotes, dashes and other marks of the block U+2010 to U+203A, and guillemets, in UTF-8.
MARKS = re.compile(rb"\xe2\x80[\x90-\xba]|\xc2[\xab\xbb]")


def hashes_of(text: bytes) -> np.ndarray:
    words = MARKS.sub(b" ", text).translate(FOLD).split()
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


@dataclass
class Group:
    """Templates of about one length, with the bands that find them."""

    longest: int
    bands: int
    rows: int
    names: list[str] = field(default_factory=list)
    sets: list[np.ndarray] = field(default_factory=list)
    #: How often a template has each of its shingles.
    often: list[Counter] = field(default_factory=list)
    table: dict[int, list[int]] = field(default_factory=dict)


def least_similarity(share: float, longest: int, shortest: int) -> float:
    """Of a window's set and a template's, if the window holds that share of the template's."""
    window = max(1, longest + longest // 2)
    return min(share * t / (window + t - share * t) for t in (shortest, longest))


def bands_for(similarity: float, rows: int, miss: float) -> int:
    """So many bands that none meets with a chance of at most `miss`."""
    meet = similarity**rows
    return 1 if meet >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-meet)))


def minhashes(elements: np.ndarray, counts: np.ndarray, registers: int) -> np.ndarray:
    """The least hash of each window's elements under each of `registers` hash functions."""
    starts = np.cumsum(counts) - counts
    return np.stack([np.minimum.reduceat(mix(elements ^ np.uint64((k + 1) * int(GOLDEN) % 2**64)), starts) for k in range(registers)], axis=1)


def band_keys(signs: np.ndarray, rows: int) -> np.ndarray:
    parts = signs.reshape(len(signs), -1, rows)
    out = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        out = mix(out * GOLDEN + parts[:, :, k])
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], percent: int = 75, rows: int = 2, miss: float = 1e-6):
        self.percent, self.groups = percent, []
        runs = {name: shingle_hashes(hashes_of(text.encode()), SHINGLE) for name, text in templates.items()}
        shingled = {name: np.unique(x) for name, x in runs.items() if len(x)}
        self.all = np.unique(np.concatenate([*shingled.values(), np.zeros(0, dtype=np.uint64)]))
        for size in sorted({len(x).bit_length() for x in shingled.values()}):
            own = {name: x for name, x in sorted(shingled.items()) if len(x).bit_length() == size}
            longest, shortest = max(map(len, own.values())), min(map(len, own.values()))
            group = Group(longest, bands_for(least_similarity(percent / 100, longest, shortest), rows, miss), rows)
            for name, x in own.items():
                for key in band_keys(minhashes(x, np.array([len(x)]), group.bands * rows), rows)[0].tolist():
                    group.table.setdefault(key, []).append(len(group.names))
                group.names.append(name)
                group.sets.append(x)
                group.often.append(Counter(runs[name].tolist()))
            self.groups.append(group)

    def windows(self, n: int, marked: np.ndarray, longest: int) -> list[tuple[int, int]]:
        """Start and end (in shingles) of the windows that hold a marked shingle; n shingles in all."""
        length, step = max(1, longest + longest // 2), max(1, longest // 2)
        first, last = np.maximum(0, -(-(marked - length + 1) // step)), marked // step
        numbers = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)]))
        return [(int(k) * step, min(n, int(k) * step + length)) for k in numbers]

    def copies(self, shingles: np.ndarray, start: int, end: int, often: Counter) -> Iterator[tuple[int, int, int]]:
        """First word, end and percentage of each copy of a template in a stretch of shingles."""
        found: list[tuple[int, int, Counter]] = []
        for k in start + np.flatnonzero(np.isin(shingles[start:end], np.fromiter(often, dtype=np.uint64, count=len(often)))):
            x = int(shingles[k])
            if not found or found[-1][2][x] >= often[x] and 100 * len(found[-1][2]) >= self.percent * len(often):
                found.append((int(k), 0, Counter()))
            first, _, seen = found[-1]
            seen[x] += 1
            found[-1] = (first, int(k) + SHINGLE, seen)
        if len(found) > 1 and 100 * len(found[-1][2]) < self.percent * len(often):
            _, last, rest = found.pop()
            found[-1] = (found[-1][0], last, found[-1][2] + rest)
        return ((first, last, 100 * len(seen) // len(often)) for first, last, seen in found)

    def scan(self, text: bytes) -> list[tuple[str, int, int, int]]:
        """License, first word, number of words and percentage of each match in a text."""
        shingles = shingle_hashes(hashes_of(text), SHINGLE)
        if not len(shingles) or not len(self.all):
            return []
        marked = np.flatnonzero(self.all[np.minimum(np.searchsorted(self.all, shingles), len(self.all) - 1)] == shingles)
        if not len(marked):
            return []
        out = []
        for group in self.groups:
            spans = self.windows(len(shingles), marked, group.longest)
            sets = [np.unique(shingles[a:b]) for a, b in spans]
            keys = band_keys(minhashes(np.concatenate(sets), np.array([len(x) for x in sets]), group.bands * group.rows), group.rows)
            hits: dict[int, list[list[int]]] = {}
            for (a, b), x, own in zip(spans, sets, keys.tolist(), strict=True):
                for t in sorted({t for k in own for t in group.table.get(k, ())}):
                    if 100 * len(np.intersect1d(x, group.sets[t], assume_unique=True)) >= self.percent * len(group.sets[t]):
                        stretches = hits.setdefault(t, [])
                        if stretches and a < stretches[-1][1]:
                            stretches[-1][1] = b
                        else:
                            stretches.append([a, b])
            for t, stretches in hits.items():
                for a, b in stretches:
                    out += [(group.names[t], start, end - start, share) for start, end, share in self.copies(shingles, a, b, group.often[t])]
        return sorted(out, key=lambda x: (x[1], x[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 75) -> DataFrame:
    """doc_id, license, first_word, n_words and percent of each match."""
    sent = docs.sparkSession.sparkContext.broadcast(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value, percent)
        for batch in batches:
            rows = [(name, *hit) for name, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch), strict=True) for hit in scanner.scan(text)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.record_batch([pa.array(x, type=t) for x, t in zip(columns, kinds, strict=True)], names=["doc_id", "license", "first_word", "n_words", "percent"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MATCH)
