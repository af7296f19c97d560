"""License scans: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans.

Words are runs of ASCII letters and digits and of non-ASCII bytes, lower case. Each template's K-word grams are hashed
and winnowed (of each WINDOW consecutive hashes the smallest is kept) into an inverted index of fixed size, known on
every executor; a template of fewer than SHORT words has all its word pairs in the index instead, as edits may leave it
no K words in a row. All grams of every text are looked up; hits of one template on nearby diagonals make a candidate, which
is aligned word by word in a band around its diagonal. A match tells the share of the template's words that stand in
order in the span, and the span in words and code points.

Defined results: null, empty or unmatched texts give no rows; of overlapping matches the one that covers more
template words stands (ties: higher coverage, then the name's order). Repeated rows give repeated matches; extra columns
are ignored; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import small_arrow_batches

K, WINDOW, BAND, SHORT = 3, 2, 8, 16

# Whole texts of short public licences, and notices and grants as licences prescribe them.
TEMPLATES: dict[str, str] = {
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT line": "Released under the MIT License",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


class Tokens(T.Words):
    """Words of letters and digits, lower case."""

    inside = _WORD

    def __init__(self, column: pa.Array):
        super().__init__(column, lower=True)


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints: of each `window` consecutive hashes the smallest, the last of equals."""
    if len(h) <= window:
        return np.unique(len(h) - 1 - np.argmin(h[::-1])) if len(h) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views, 1))


class Index:
    """The inverted index: fingerprint hashes in order, and the template and place of each."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        w = Tokens(pa.array([templates[n] for n in self.names], pa.string()))
        x = w.hashes()
        self.words = [x[w.first[i] : w.first[i + 1]] for i in range(w.rows)]
        out = []
        for i in range(w.rows):
            short = len(self.words[i]) < SHORT
            h, at = T.grams(w, x, 2 if short else K)
            mine = np.flatnonzero(w.doc[at] == i)
            keep = mine if short else mine[winnow(h[mine], WINDOW)]
            out += [(h[j], i, at[j] - w.first[i]) for j in keep]
        out.sort()
        self.hash = np.array([o[0] for o in out], np.uint64)
        self.template = np.array([o[1] for o in out])
        self.place = np.array([o[2] for o in out])


def align(template: np.ndarray, words: np.ndarray, diagonal: int, low: int, high: int) -> tuple[int, int, int] | None:
    """Banded alignment of the template with words around `diagonal` (word place minus template place), of which hits
    spread from `low` to `high`: matched words, and the first and last word of the span. A longest common subsequence
    whose steps stay in the band; of equals the shortest span."""
    width = high - low + 2 * BAND + 1
    base = low - BAND
    # best[b]: (matched, -start) of alignments ending at this template word in the band's place b
    best = [(0, 0)] * (width + 1)
    top, end = (0, 0), -1
    for i, t in enumerate(template):
        now, left = [], (0, 0)
        for b in range(width):
            j = i + base + b
            over, diag = best[b + 1] if b + 1 < width else (0, 0), best[b]
            x = max(over, left)
            if 0 <= j < len(words) and words[j] == t:
                x = max(x, (diag[0] + 1, diag[1] if diag[0] else -j))
                if x > top and x[0] == diag[0] + 1:
                    top, end = x, j
            now.append(x)
            left = x
        best = [*now, (0, 0)]
    return (top[0], -top[1], end) if top[0] else None


MATCH = "doc_id bigint, license string, coverage double, n_matched int, n_template int, start_word int, end_word int, start_char int, end_char int"
_MATCH = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), *((c, pa.int32()) for c in ("n_matched", "n_template", "start_word", "end_word", "start_char", "end_char"))])


def matches(index: Index, words: np.ndarray, place: np.ndarray, entry: np.ndarray, least: float) -> list[tuple]:
    """Matches of one text (word hashes) from its hits: places of grams and entries of the index they hit."""
    found = []
    for t in np.unique(index.template[entry]):
        at = place[index.template[entry] == t]
        diagonal = at - index.place[entry][index.template[entry] == t]
        order = np.lexsort((at, diagonal))
        at, diagonal, free = at[order], diagonal[order], words.copy()
        while len(at):
            near = diagonal <= diagonal[0] + BAND
            got = align(index.words[t], free, int(diagonal[0]), int(diagonal[0]), int(diagonal[near].max()))
            gone = near.copy()
            if got and got[0] >= least * len(index.words[t]):
                found.append((got[0], got[0] / len(index.words[t]), int(t), got[1], got[2]))
                gone = (at >= got[1]) & (at <= got[2])
                free[got[1] : got[2] + 1] = 0  # each word stands in one match of a template
                gone[0] = True
            at, diagonal = at[~gone], diagonal[~gone]
    found.sort(key=lambda m: (-m[0], -m[1], m[2], m[3]))
    kept: list[tuple] = []
    for m in found:
        if all(m[4] < k[3] or m[3] > k[4] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[3])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """All matches of `least` coverage or more: one row for each, with spans (end exclusive).

    Certain for words replaced or left out at `least` 0.8; words put in between count nothing, but where they leave a
    template none of its indexed grams in a row, it is not found."""
    small_arrow_batches(docs.sparkSession)
    index = Index(templates or TEMPLATES)

    def run(batches):
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id").to_pylist() if batch.num_rows else []
            for lo, hi in T.chunks(texts):
                w = Tokens(texts[lo:hi])
                x = w.hashes()
                h, at = (np.concatenate(c) for c in zip(T.grams(w, x, 2), T.grams(w, x, K)))
                first, past = np.searchsorted(index.hash, h, "left"), np.searchsorted(index.hash, h, "right")
                hit = np.flatnonzero(past > first)
                if not len(hit):
                    continue
                n = (past - first)[hit]
                entry = np.repeat(first[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                where = np.repeat(at[hit], n)
                chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
                out = []
                for row in np.unique(w.doc[where]):
                    mine = w.doc[where] == row
                    f = w.first[row]
                    for count, coverage, t, a, b in matches(index, x[f : w.first[row + 1]], where[mine] - f, entry[mine], least):
                        zero = chars[w.offsets[row]]
                        out.append((ids[lo + row], index.names[t], coverage, count, len(index.words[t]), a, b + 1, int(chars[w.start[f + a]] - zero), int(chars[w.end[f + b]] - zero)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MATCH)], schema=_MATCH)
        T.give_back()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, MATCH)
