"""Licence scan: normalised text compared with licence templates by the Dice coefficient over word bigrams.

A passage is any run of words, wherever its lines begin and end. Words are normalised (lower case, letters and digits only; years and
numbers are one word "0"), and passage and template are compared as multisets of bigrams: 2 * shared / (size + size), a match from
`threshold` on. Pruning never loses a match: by the coefficient a match's size is at most (2 - t) / t times the template's, and it
shares at least t / (2 - t) of the template's bigrams. So that many bigrams of the template stand within that many words, which numpy
finds for whole Arrow batches from hashes; only texts with such places are compared, by their real words. Every passage there that
begins and ends with a shared bigram is scored; others have a better one inside.

Of overlapping passages like one template the best score stays, then the longer one; of overlapping matches of several templates the one
that shares most bigrams stays, then the best score (a long notice holds the short ones).

Defined results: a null or empty text has no match (licenses "", best_score 0.0). Rows are judged one by one: repeated rows get equal
results and an empty table gives an empty table. A template of one word counts as one bigram of its own. Other columns are not read. A text is
compared where template bigrams stand close; work there grows with its length, times the template's length for long runs of one licence.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import arrow_map, chunks, table, utf8

# Notices and texts of common public licences.
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_DISCLAIMER = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_TERMS = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
_BSD_THIRD = ' 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'
_BSD_DISCLAIMER = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_DISCLAIMER = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Kinds of the GNU licences; their versions aren't told apart, as numbers are one word.
_GNU = {"GPL": "General", "LGPL": "Lesser General", "AGPL": "Affero General"}


def _gnu_notices(kind: str) -> tuple[str, ...]:
    name = f"GNU {kind} Public License"
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.",
        f"Licensed under the {name}, version 3.",
        f"This work is licensed under the {name}, version 3.",
    )


TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Licensed under the MIT License.",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        _MIT_GRANT,
        _MIT_NOTICE,
        _MIT_GRANT + " " + _MIT_NOTICE + _MIT_DISCLAIMER,
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "BSD-2-Clause": (_BSD_TERMS + _BSD_DISCLAIMER,),
    "BSD-3-Clause": (_BSD_TERMS + _BSD_THIRD + _BSD_DISCLAIMER,),
    "ISC": (_ISC_GRANT, _ISC_GRANT + _ISC_DISCLAIMER),
    **{name: _gnu_notices(x) for name, x in _GNU.items()},
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("Copyright 2020. All rights reserved.", "All rights reserved."),
}


@dataclass(frozen=True)
class Scan:
    """Production parameters."""

    threshold: float = 0.8
    chunk_bytes: int = 1 << 20


PARAMS = Scan()
_WORD = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")


def words_of(text: str) -> list[str]:
    return ["0" if w[0].isascii() and w[0].isdigit() else w for w in _WORD.findall(text.translate(_LOWER_TEXT))]


_LOWER_TEXT = {i: i + 32 for i in range(65, 91)}


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter([(w, "") for w in words])


def dice(a: Counter, b: Counter) -> float:
    return 2 * (a & b).total() / max(a.total() + b.total(), 1)


class Templates:
    def __init__(self, texts: dict[str, tuple[str, ...]], p: Scan):
        self.p = p
        both = sorted(((k, bigrams(words_of(t))) for k, v in texts.items() for t in v), key=lambda x: x[1].total())
        self.all = [(k, b) for k, b in both if b]
        t, slack = p.threshold, 1e-9  # for rounding
        self.sizes = [b.total() for _, b in self.all]
        self.most = [int(n * (2 - t) / t + slack) for n in self.sizes]
        self.least = [max(1, math.ceil(n * t / (2 - t) - slack)) for n in self.sizes]
        self.largest = max(self.most, default=0)
        pairs = sorted({g for _, b in self.all for g in b})
        self.pairs = {g: i for i, g in enumerate(pairs)}
        self.counts = np.array([[b[g] for g in pairs] for _, b in self.all], np.int64).reshape(len(self.all), len(pairs))
        # the same by hashes, which may be equal for different words
        words = {w: _hash(w) for g in pairs for w in g if w}
        self.hashes = np.unique(np.array(list(words.values()), np.uint64))
        at = {w: int(np.searchsorted(self.hashes, np.uint64(h))) for w, h in words.items()}
        n = len(self.hashes)
        grid = np.full((n, n + 1), -1, np.int32)  # last column: a word alone
        for a, b in pairs:
            i, j = at[a], at[b] if b else n
            grid[i, j] = grid.max(initial=-1) + 1 if grid[i, j] < 0 else grid[i, j]
        self.grid = grid
        self.has = np.zeros((len(self.all), int(grid.max(initial=-1)) + 1), bool)
        for k, (_, c) in enumerate(self.all):
            for a, b in c:
                self.has[k, grid[at[a], at[b] if b else n]] = True


def _hash(w: str) -> int:
    data, offsets = utf8(pa.array([w]))
    return int(_word_hashes(data, offsets)[0][0])


_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[128:] = 3
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _word_hashes(data: np.ndarray, offsets: np.ndarray):
    """Hash and start of each normalised word: runs of one class of bytes; numbers all alike. Words of up to 8 bytes exactly, longer ones by their first 8 and length."""
    low = _LOW[data]
    kind = np.concatenate((_CLASS[low], [0])).astype(np.uint8)
    edge = np.zeros(len(kind), bool)
    edge[offsets] = True
    before = np.concatenate(([0], kind[:-1])).astype(np.uint8)
    starts = np.flatnonzero((kind > 0) & ((before != kind) | edge))
    ends = np.flatnonzero((before > 0) & ((before != kind) | edge))
    padded = np.concatenate((low, np.zeros(8, np.uint8)))
    at = np.ndarray((len(low) + 1,), "<u8", padded, strides=(1,))
    n = ends - starts
    mask = np.concatenate(((np.uint64(1) << (8 * np.arange(8, dtype=np.uint64))) - np.uint64(1), [np.uint64(0xFFFFFFFFFFFFFFFF)]))
    h = (at[starts] & mask[np.minimum(n, 8)]) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.where(kind[starts] == 2, np.uint64(1), h), starts


def candidates(data: np.ndarray, offsets: np.ndarray, t: Templates) -> dict[int, list[int]]:
    """Texts that can have a match -> numbers of the templates: as many of the template's bigrams as a match shares, no farther apart than its size."""
    h, starts = _word_hashes(data, offsets)
    if not len(h) or not len(t.hashes):
        return {}
    at = np.minimum(np.searchsorted(t.hashes, h), len(t.hashes) - 1)
    known = t.hashes[at] == h
    out: dict[int, list[int]] = {}

    def places(first: np.ndarray, pair: np.ndarray):
        first, pair = first[pair >= 0], pair[pair >= 0]
        text = np.searchsorted(offsets, starts[first], side="right") - 1
        return first, pair, text

    one = np.flatnonzero(known)
    two = one[:-1][np.diff(one) == 1]
    alone = places(one, t.grid[at[one], -1])
    first, pair, text = places(two, t.grid[at[two], at[two + 1]])
    inside = starts[first + 1] < offsets[text + 1]
    first, pair, text = first[inside], pair[inside], text[inside]
    place = first + text * (t.largest + 1)  # no window reaches into the next text
    for k, (_, b) in enumerate(t.all):
        if any(not y for _, y in b):
            found = alone[2][t.has[k, alone[1]]]
        else:
            own = np.flatnonzero(t.has[k, pair])
            near = place[own]
            s = t.least[k] - 1
            found = text[own[: max(len(own) - s, 0)][near[s:] - near[: max(len(near) - s, 0)] < t.most[k]]]
        for x in np.unique(found).tolist():
            out.setdefault(x, []).append(k)
    return out


def passages(place: np.ndarray, pair: np.ndarray, k: int, t: Templates) -> list[tuple[int, float, int, int]]:
    """(shared, score, first, last bigram) of the best passages like template k; place and pair: the text's bigrams that the template has."""
    n, most, total, s = len(place), t.most[k], t.sizes[k], t.least[k] - 1
    rows = np.flatnonzero(place[s:] - place[: max(n - s, 0)] < most)
    if not len(rows):
        return []
    # a bigram counts in passages that begin after its equal as many places before as the template has of it
    order = np.argsort(pair, kind="stable")
    many = t.counts[k][pair[order]]
    i = np.arange(n) - many
    before = np.full(n, -1)
    before[order] = np.where((i >= 0) & (pair[order[np.maximum(i, 0)]] == pair[order]), order[np.maximum(i, 0)], -1)
    reach = np.searchsorted(place, place + most) - np.arange(n)
    found = []
    at_once = max(1, (1 << 21) // int(reach.max()))
    for r in range(0, len(rows), at_once):
        a = rows[r : r + at_once, None]
        b = a + np.arange(int(reach[a].max()))
        inside = b < a + reach[a]
        b = np.minimum(b, n - 1)
        counts = inside & (before[b] < a)
        shared = np.cumsum(counts, axis=1)
        size = place[b] - place[a] + 1
        score = 2 * shared / (size + total)
        x, y = np.nonzero(counts & (score >= t.p.threshold))
        found.append((shared[x, y], score[x, y], place[a[x, 0]], place[b[x, y]]))
    shared, score, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
    best = np.lexsort((first, first - last, -score))
    return _apart(list(zip(*(c[best].tolist() for c in (shared, score, first, last)), strict=True)))


def _apart(ranked: list[tuple]) -> list[tuple]:
    """Those of (shared, score, first bigram, last bigram, ...) that share no word with an earlier one."""
    taken = bytearray(max((x[3] for x in ranked), default=0) + 2)
    out = []
    for x in ranked:
        if taken.find(1, x[2], x[3] + 2) < 0:
            taken[x[2] : x[3] + 2] = b"\1" * (x[3] + 2 - x[2])
            out.append(x)
    return out


def scan_text(text: str, near: list[int] | None, t: Templates) -> list[tuple[float, str, int, int]]:
    """(score, licence, first line, last line) of the best matches that don't overlap; near: numbers of the templates to compare, None for all."""
    low = text.translate(_LOWER_TEXT)
    spans = [(m.start(), "0" if m[0][0].isascii() and m[0][0].isdigit() else m[0]) for m in _WORD.finditer(low)]
    words = [w for _, w in spans]
    pairs = np.array([t.pairs.get(g, -1) for g in zip(words, words[1:], strict=False)], np.int64)
    known = np.flatnonzero(pairs >= 0)
    found = []
    for k in range(len(t.all)) if near is None else near:
        name, b = t.all[k]
        if alone := next((x for x, y in b if not y), None):
            found += [(1, 1.0, i, i - 1, name) for i, w in enumerate(words) if w == alone]
            continue
        own = known[t.counts[k][pairs[known]] > 0]
        found += [(*x, name) for x in passages(own, pairs[own], k, t)]
    out = _apart(sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3], x[4])))
    breaks = [k for k, c in enumerate(text) if c == "\n"] if out else []
    line = lambda word: bisect.bisect_left(breaks, spans[word][0])
    return [(s, name, line(i), line(j + 1)) for _, s, i, j, name in sorted(out, key=lambda x: x[2])]


def read_templates(spark, path: str) -> dict[str, tuple[str, ...]]:
    """TEMPLATES with whole licences from a folder of text files, named by the file without its ending: a handful of files, read by the driver."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("name"), "value").orderBy("name").collect()
    out = dict(TEMPLATES)
    for name, text in files:
        out[name] = (*out.get(name, ()), text)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict = TEMPLATES, p: Scan = PARAMS) -> DataFrame:
    """doc_id, n_matches, licenses (distinct, sorted, comma-joined), best_score, spans (license, score, first_line, last_line)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = pa.struct([("license", pa.string()), ("score", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())])

    held = docs.sparkSession.sparkContext.broadcast(Templates(templates, p))

    def run(batches):
        t = held.value
        for b in batches:
            data, offsets = utf8(b.column(1))
            rows: list[list] = [[] for _ in range(b.num_rows)]
            for i, j in chunks(offsets, p.chunk_bytes):
                for k, near in candidates(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], t).items():
                    rows[i + k] = scan_text(data[offsets[i + k] : offsets[i + k + 1]].tobytes().decode(), near, t)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([",".join(sorted({x[1] for x in r})) for r in rows], pa.string()),
                    pa.array([max((x[0] for x in r), default=0.0) for r in rows], pa.float64()), pa.array([[{"license": n, "score": s, "first_line": a, "last_line": z} for s, n, a, z in r] for r in rows], pa.list_(span)),
                ],
                ["doc_id", "n_matches", "licenses", "best_score", "spans"],
            )

    return arrow_map(d, run, f"doc_id {dict(d.dtypes)['doc_id']}, n_matches bigint, licenses string, best_score double, spans array<struct<license: string, score: double, first_line: int, last_line: int>>")


def op4(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_matches", "licenses", F.round("best_score", 6).alias("best_score"))
