"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Every template is cut into grams of ``GRAM`` words; winnowing keeps the least hash of each window of
``WINDOW`` grams, and an inverted index leads from these fingerprints to (template, place).  A text is
scanned by all its grams, so any ``GRAM + WINDOW - 1`` words in common with a template are found.
Hits of one template on neighbouring diagonals (text place less template place) are one candidate.
A candidate is aligned word by word with the whole template in a band around its diagonals (match
+2, mismatch -1, gap -1; best local alignment), which gives the matched words, the coverage of the
template and both spans; what lies left and right of the best alignment is aligned again, so that
repeated notices are found each.  Alignments of one template in the same order in text and template
form a chain: a license with something put in its middle is one passage, from its first word to its
last.  Reported are passages that cover at least ``coverage`` of the template, and shorter ones (cut
licenses) of at least ``least_words`` words and ``least_share`` of it.  Of passages that overlap in a
text, whole ones come before cut ones, and then the highest score stays, whatever its template.

Templates are a driver-side table of fixed, checked size (``MAX_TEMPLATE_BYTES``); texts are read once,
whole, without any exchange.  Cases: null and empty texts match nothing; rows without a doc_id are left
out; repeated rows are reported each; ties of the score go to the earlier span; an empty table, or no
templates, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import core

GRAM, WINDOW = 3, 2
BAND = 16
COVERAGE = 0.8
LEAST_WORDS, LEAST_SHARE = 20, 0.25
MAX_TEMPLATE_BYTES = 4 << 20

_OUT = "doc_id bigint, license string, coverage double, n_matched bigint, score bigint, doc_start bigint, doc_end bigint, template_start bigint, template_end bigint"

_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE."
)


def _gnu() -> dict[str, str]:
    """Notices and headers of the GNU licenses besides the GPL 3."""
    out = {}
    for short, name, versions in (("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",))):
        for v in versions:
            key = f"{short}-{v}" if "." in v else f"{short}-{v}.0"
            what = "library is free software; you" if key == "LGPL-2.1" else "program is free software: you"
            noun = "library" if key == "LGPL-2.1" else "program"
            out[f"{key}-abbreviated"] = f"Licensed under the {short} version {v}."
            out[f"{key}-joined"] = f"Licensed under the {short}v{v}."
            if key == "GPL-3.0":
                continue
            out[f"{key}-notice"] = f"This work is licensed under the {name}, version {v}."
            out[f"{key}-header"] = (
                f"This {what} can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either "
                f"version {v} of the License, or (at your option) any later version. This {noun} is distributed in the hope that it will be useful, but "
                "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
                f"{name} for more details."
            )
    return out


def _creative_commons() -> dict[str, str]:
    """Notices of the six licenses, spelled out and abbreviated."""
    words = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    out = {}
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        name = "-".join(words[k] for k in kind.split("-"))
        for v, which in (("4.0", "International"), ("3.0", "Unported"), ("2.0", "Generic")):
            if v != "4.0" or kind not in ("BY", "BY-SA"):
                out[f"CC-{kind}-{v}-notice"] = f"This work is licensed under a Creative Commons {name} {v} {which} License."
            out[f"CC-{kind}-{v}-spelled"] = f"Licensed under the Creative Commons {name} {v} License."
            out[f"CC-{kind}-{v}-short"] = f"Licensed under CC {kind} {v}."
    return out


#: Notices and texts of widespread public licenses, by name.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
    "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
    'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations "
    "under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
    "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
    "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
    "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
    'or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
    "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
    "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": _BSD_2 + _BSD_END,
    "BSD-3-Clause": _BSD_2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. " + _BSD_END,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, "
    "and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you "
    "must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would "
    "be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
    "original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
    "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to "
    "the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
    "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE "
    'IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "MPL-2.0-short": "Licensed under the Mozilla Public License, version 2.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC0-1.0-short": "Licensed under CC0 1.0 Universal.",
    "MIT-short": "Licensed under the MIT License.",
    "ISC-short": "Licensed under the ISC License.",
    "BSD-2-Clause-short": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause-short": "Licensed under the BSD 3-Clause License.",
    **_gnu(),
    **_creative_commons(),
}


def align(a: np.ndarray, b: np.ndarray, low: int, high: int) -> tuple[int, int, int, int, int, int]:
    """Best local alignment of ``a`` (rows) with ``b`` where ``low <= column - row <= high``.

    (score, matches, start and end in ``a``, start and end in ``b``); the first best end wins, and a
    step back prefers a match or mismatch, then a gap in ``a``, then one in ``b``.
    """
    n, m = len(a), len(b)
    width = high - low + 1
    scores = np.zeros((n + 1, width + 1), dtype=np.int32)  # the last column stands for outside
    steps = np.arange(width)
    for i in range(1, n + 1):
        col = steps + i + low  # of b, from 1
        inside = (col >= 1) & (col <= m)
        same = np.zeros(width, dtype=bool)
        same[inside] = b[col[inside] - 1] == a[i - 1]
        best = np.maximum(scores[i - 1, :width] + np.where(same, 2, -1), scores[i - 1, 1 : width + 1] - 1)
        best = np.where(inside, np.maximum(best, 0), 0)
        best = np.maximum(best, np.maximum.accumulate(best + steps) - steps)
        scores[i, :width] = np.where(inside, best, 0)
    end = int(np.argmax(scores[:, :width]))
    i, d = divmod(end, width)
    score, matches = int(scores[i, d]), 0
    ei, ej = i, i + low + d
    while i > 0 and scores[i, d] > 0:
        j = i + low + d
        same = 1 <= j <= m and b[j - 1] == a[i - 1]
        if scores[i, d] == scores[i - 1, d] + (2 if same else -1):
            matches += same
            i -= 1
        elif scores[i, d] == scores[i - 1, d + 1] - 1 and d + 1 < width:
            i, d = i - 1, d + 1
        elif d and scores[i, d] == scores[i, d - 1] - 1:
            d -= 1
        else:
            break
    return score, matches, i, ei, i + low + d, ej


def _apart(rows: Iterable[tuple[tuple, list[tuple[int, int]]]]) -> list[tuple]:
    """The rows, first come first served, whose spans overlap none before."""
    kept, starts, ends = [], [], []
    for row, spans in rows:
        at = [bisect.bisect_left(ends, a + 1) for a, _ in spans]
        if all(k == len(starts) or starts[k] >= z for k, (_, z) in zip(at, spans)):
            kept.append(row)
            for a, z in spans:
                k = bisect.bisect_left(starts, a)
                starts.insert(k, a)
                ends.insert(k, z)
    return kept


class Index:
    """Templates' words and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str], gram: int, window: int) -> None:
        self.gram = gram
        w = core.words_of(pa.array(list(templates.values()), pa.string()))
        self.names = list(templates)
        self.words = [w.hash[a:z] for a, z in zip(w.off[:-1].tolist(), w.off[1:].tolist())]
        key, owner, place = [], [], []
        for t, h in enumerate(self.words):
            if len(h) < gram:
                raise ValueError(f"template {self.names[t]!r} has fewer than {gram} words")
            g = core.grams(h, gram)
            picked = {int(i + np.argmin(g[i : i + window])) for i in range(max(1, len(g) - window + 1))} if len(g) else set()
            for i in sorted(picked):
                key.append(g[i])
                owner.append(t)
                place.append(i)
        o = np.argsort(np.array(key, dtype=np.uint64), kind="stable")
        self.key = np.array(key, dtype=np.uint64)[o]
        self.owner = np.array(owner, dtype=np.int64)[o]
        self.place = np.array(place, dtype=np.int64)[o]


def _scan(index: Index, band: int, coverage: float, least_words: int, least_share: float):
    known: dict[tuple, tuple] = {}

    def one(words: np.ndarray, t: int, low: int, high: int, left: int, right: int) -> tuple:
        """The best alignment of template ``t`` with a text's words left..right around the diagonals low..high."""
        a = index.words[t]
        begin, end = max(left, low - band), min(right, high + len(a) + band)
        b = words[begin:end]
        key = (t, low - begin, high - begin, b.tobytes()) if len(b) < 4096 else None
        got = known.get(key) if key else None
        if got is None:
            got = align(a, b, low - begin - band, high - begin + band)
            if key:
                if len(known) > 1 << 14:
                    known.clear()
                known[key] = got
        score, matches, i, ei, j, ej = got
        return score, matches, begin + j, begin + ej, i, ei

    def pieces(words: np.ndarray, t: int, at: np.ndarray, place: np.ndarray) -> list[tuple]:
        """Alignments of template ``t`` that do not overlap in the text, by their starts."""
        found = []
        todo = [(0, len(words), np.arange(len(at)))]
        while todo:
            left, right, hits = todo.pop()
            diag = at[hits] - place[hits]
            o = np.argsort(diag, kind="stable")
            hits, diag = hits[o], diag[o]
            cut = np.flatnonzero(np.diff(diag) > band) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(diag)]):
                row = one(words, t, int(diag[i]), int(diag[j - 1]), left, right)
                if row[1] < index.gram:
                    continue
                found.append(row)
                some = hits[i:j]
                for lo, hi, rest in ((left, row[2], some[at[some] + index.gram <= row[2]]), (row[3], right, some[at[some] >= row[3]])):
                    if len(rest):
                        todo.append((lo, hi, rest))
        return sorted(_apart((r, [r[2:4]]) for r in sorted(found, key=lambda r: (-r[0], r[2]))), key=lambda r: r[2])

    def chains(t: int, parts: list[tuple]) -> Iterator[tuple[tuple, list]]:
        """Passages made of alignments in the same order in text and template, and the parts of each."""
        size = len(index.words[t])
        yield from ((r, [r[2:4]]) for r in parts if r[1] >= coverage * size)
        parts = [r for r in parts if r[1] < coverage * size]
        while parts:
            best: list[tuple[int, int | None]] = []
            for k, r in enumerate(parts):
                most = (r[1], None)
                for j in range(k):
                    x = parts[j]
                    twice = max(0, x[5] - r[4])
                    near = r[2] - x[3] <= size or min(r[1], x[1]) >= least_words
                    if near and x[4] < r[4] and twice <= index.gram and best[j][0] + r[1] - twice > most[0]:
                        most = (best[j][0] + r[1] - twice, j)
                best.append(most)
            k = max(range(len(parts)), key=lambda k: (best[k][0], -k))
            matches, chain = best[k][0], []
            while k is not None:
                chain.append(k)
                k = best[k][1]
            held = [parts[k] for k in reversed(chain)]
            if matches < min(coverage * size, max(least_words, least_share * size)):
                return  # no other chain has more
            yield (sum(r[0] for r in held), matches, held[0][2], held[-1][3], held[0][4], held[-1][5]), [r[2:4] for r in held]
            parts = [r for k, r in enumerate(parts) if k not in set(chain)]

    def matches_of(words: np.ndarray, at: np.ndarray, owner: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        rows = []
        for t in np.unique(owner).tolist():
            mine = owner == t
            size = len(index.words[t])
            rows += [((*r, t, r[1] / size), spans) for r, spans in chains(t, pieces(words, t, at[mine], place[mine]))]
        rows.sort(key=lambda x: (x[0][7] < coverage, -x[0][0], x[0][2], x[0][6]))
        for score, matches, j, ej, i, ei, t, share in sorted(_apart(rows), key=lambda r: (r[2], r[6])):
            yield index.names[t], share, matches, score, j, ej, i, ei

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in core.slices(batch):
                w = core.words_of(b.column("text"))
                g = core.grams(w, index.gram)
                if not len(g) or not len(index.key):
                    continue
                lo = np.searchsorted(index.key, g)
                hit = (index.key[np.minimum(lo, len(index.key) - 1)] == g) & (w.room[: len(g)] >= index.gram)
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                n = np.searchsorted(index.key, g[at], side="right") - lo[at]
                entry = np.repeat(lo[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                at = np.repeat(at, n)
                doc = np.searchsorted(w.off, at, side="right") - 1
                ids = b.column("doc_id").to_pylist()
                cuts = np.flatnonzero(np.diff(doc)) + 1
                rows = []
                for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)]):
                    d = int(doc[i])
                    words = w.hash[w.off[d] : w.off[d + 1]]
                    rows += [(ids[d], *r) for r in matches_of(words, at[i:j] - w.off[d], index.owner[entry[i:j]], index.place[entry[i:j]])]
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 6]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _OUT.split(", ")])

    return run


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, *, gram: int = GRAM, window: int = WINDOW, band: int = BAND, coverage: float = COVERAGE,
    least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE,
) -> DataFrame:
    """(doc_id, license, coverage, n_matched, score, spans in words) of every license passage."""
    templates = TEMPLATES if templates is None else templates
    if sum(len(t.encode()) for t in templates.values()) > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates hold more than {MAX_TEMPLATE_BYTES} bytes")
    base = core.pick(docs, "doc_id", "text").where("doc_id IS NOT NULL").selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return base.mapInArrow(core.lean(_scan(Index(templates, gram, window), band, coverage, least_words, least_share)), _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(core.table(spark, sf_dir, "documents"))
