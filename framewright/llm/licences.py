"""Licence scan: winnowed fingerprints find candidate places, a banded alignment measures them.

Templates are few and fixed, so their inverted index (fingerprint to template and position) is a small
constant that every task holds.  A text's word runs are looked up in it; hits on nearly the same diagonal
are one candidate, and its window is aligned with the template inside a band.  A licence is named only if
the words that tell it from others (names, versions, conditions) are all there, in order, and no others of
that kind are.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .shared import flat_map_texts, map_texts

GRAM, WINDOW = 3, 3
BAND = 6
MIN_COVERAGE = 0.8

# Public licences (fixed values): whole texts of short ones without their copyright lines; of long ones the
# whole notice that they tell authors to put into files (-header), and their own first lines (-opening), by
# which whole copies of them are found; one-line statements (-notice).
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "apache-2.0-opening": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "gpl-3.0-opening": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "lgpl-3.0-opening": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "mpl-2.0-opening": "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
}

# Words that tell licences apart (fixed values): names and conditions; and words that a version follows.
TELLING = frozenset("mit apache bsd isc zlib gnu gpl lgpl agpl lesser affero mozilla mpl eclipse epl cc creative commons attribution noncommercial sharealike noderivatives noderivs".split())
VERSION_AFTER = frozenset("version v license licence".split())

_word = re.compile(r"\w+")


def _grams(ids: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of runs of ``gram`` word ids."""
    n = len(ids) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = ids[:n].astype(np.uint64)
    for j in range(1, gram):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[j : n + j].astype(np.uint64)
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xD6E8FEB86659FD93)


def winnow(hashes: np.ndarray, window: int) -> list[int]:
    """Positions of each window's minimum, the rightmost on ties."""
    n = len(hashes)
    if n == 0:
        return []
    picked = []
    for at in range(max(1, n - window + 1)):
        part = hashes[at : at + window]
        low = at + len(part) - 1 - int(np.argmin(part[::-1]))
        if not picked or picked[-1] != low:
            picked.append(low)
    return picked


def band_of(n: int) -> int:
    """Words by which a match of a template of ``n`` may drift: never so many that it reaches a copy beside it."""
    return max(2, min(BAND, n // 4), n // 16)


class Index:
    """Templates as word ids, and their fingerprints' places."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW):
        self.names = list(templates)
        self.vocab: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        self.bands: list[int] = []
        self.telling: list[list[str]] = []
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.gram = gram
        for t, text in enumerate(templates.values()):
            ids = np.array([self.vocab.setdefault(w.lower(), len(self.vocab) + 1) for w in _word.findall(text)], dtype=np.int64)
            self.words.append(ids)
            self.bands.append(band_of(len(ids)))
            self.telling.append(telling(text, [m.span() for m in _word.finditer(text)], 0, len(ids) - 1))
            hashes = _grams(ids, gram)
            for p in winnow(hashes, window):
                self.places[int(hashes[p])].append((t, p))
        self.keys = np.array(sorted(self.places), dtype=np.uint64)

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, diagonal, position) of every run of known words that is a fingerprint."""
        hashes = _grams(ids, self.gram)
        if not len(hashes):
            return []
        known = ids > 0
        whole = known[: len(hashes)].copy()
        for j in range(1, self.gram):
            whole &= known[j : len(hashes) + j]
        at = np.flatnonzero(whole)
        at = at[np.isin(hashes[at], self.keys)]
        return [(t, int(i) - p, int(i)) for i in at for t, p in self.places[int(hashes[i])]]


@lru_cache(maxsize=4)
def _index(items: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(items))


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Most template words matched in order within ``band`` of a diagonal, and the first and last matched word.

    ``words[i]`` lies on the diagonal of ``template[i - shift]``.  A longest common subsequence over the
    band's cells only, ties towards the diagonal's earlier cells.
    """
    width = 2 * band + 1
    n = len(template)
    best: list[list[tuple[int, int, int]]] = [[(0, -1, -1)] * (width + 1)]
    for t in range(n):
        before, row = best[-1], [(0, -1, -1)]
        for k in range(width):
            i = t + shift + k - band
            up = before[k + 2] if k + 2 <= width else (0, -1, -1)
            top = max(up, row[k], key=lambda c: c[0])
            if 0 <= i < len(words) and words[i] == template[t]:
                d = before[k + 1]
                if d[0] + 1 > top[0]:
                    top = (d[0] + 1, d[1] if d[0] else i, i)
            row.append(top)
        best.append(row)
    return max(best[-1], key=lambda c: c[0])


_number = re.compile(r"v?[0-9]+").fullmatch


def telling(text: str, places: list[tuple[int, int]], first: int, last: int) -> list[str]:
    """The words among ``first`` to ``last`` that tell licences apart, and those joined on to the ends.

    They are names and conditions, what a hyphen joins to one, what follows cc, and versions: numbers after a name or a word
    like version, with what a full stop joins to them; a version's .0 says nothing.
    """
    found: list[str] = []
    words: list[str] = []
    marked: list[bool] = []
    while first and text[places[first - 1][1] : places[first][0]] == "-":
        first -= 1
    begin = max(0, first - 3)
    for k in range(begin, len(places)):
        a, b = places[k]
        word = text[a:b].lower()
        joint = text[places[k - 1][1] : a] if k > begin else ""
        if k > last and joint not in ("-", "."):
            break
        after = marked[-1:] == [True]
        number = _number(word) is not None
        mark = word in TELLING or words[-1:] == ["cc"] or (after and (joint == "-" or (number and joint == ".")))
        mark = mark or (number and (any(marked[-2:]) or any(w in VERSION_AFTER for w in words[-2:])))
        words.append(word)
        marked.append(mark)
        if k >= first and mark and not (word == "0" and joint == "." and after):
            found.append(word.lstrip("v") if number else word)
    return found


def _common(template: np.ndarray, words: np.ndarray, size: int) -> int:
    """Words in common in whatever order, so no alignment has more."""
    return int(np.minimum(np.bincount(template, minlength=size)[1:], np.bincount(words, minlength=size)[1:]).sum())


def apart(found: list[tuple[int, float, int, int, int]]) -> list[tuple[int, float, int, int, int]]:
    """Of spans (matched, coverage, first, last, template) those that overlap none before them in rank, by place."""
    kept: list[tuple[int, int, tuple]] = []
    for f in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[4])):
        at = bisect.bisect_left(kept, (f[2],))  # kept ones are apart, so only the neighbours can overlap
        if (at == len(kept) or f[3] < kept[at][0]) and (at == 0 or kept[at - 1][1] < f[2]):
            kept.insert(at, (f[2], f[3], f))
    return [f for _, _, f in kept]


def matches(text: str, index: Index, min_coverage: float = MIN_COVERAGE) -> list[tuple[str, int, float, int, int]]:
    """(template, matched words, coverage, start, stop) of licence texts found, by start; overlaps go to the one that matches more.

    Coverage is the share of the template's words.  A find needs ``min_coverage`` of the template's and the
    other words within its stretch together, so words put in between cost as much as words left out, and
    exactly the telling words of the template.
    """
    look = index.vocab.get
    ids = np.array([look(w.lower(), 0) for w in _word.findall(text)], dtype=np.int64)
    hits = index.hits(ids)
    if not hits:
        return []
    diagonals: dict[int, list[int]] = defaultdict(list)
    for t, diagonal, _ in sorted(hits):
        if not diagonals[t] or diagonal > diagonals[t][-1] + index.bands[t] // 2:
            diagonals[t].append(diagonal)
    found = []
    places = [m.span() for m in _word.finditer(text)]
    for t, several in diagonals.items():
        template, band = index.words[t], index.bands[t]
        for diagonal in several:
            lo = max(0, diagonal - band)
            window = ids[lo : max(0, diagonal + len(template) + band)]
            if _common(template, window, len(index.vocab) + 1) < min_coverage * len(template):
                continue
            n, first, last = align(template, window, diagonal - lo, band)
            between = last - first + 1 - n
            if n >= min_coverage * (len(template) + between) and telling(text, places, lo + first, lo + last) == index.telling[t]:
                found.append((n, n / len(template), lo + first, lo + last, t))
    return [(index.names[t], n, c, places[a][0], places[b][1]) for n, c, a, b, t in apart(found)]


SCHEMA = "license string, matched int, coverage double, start int, stop int"


def scan_licences(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per licence text found: ``id_col``, license, matched, coverage, start and stop in code points.

    Whole texts are scanned.  Null and empty texts, and an empty table, give no rows; repeated rows give
    theirs each; a null id is kept; other columns are not read.  Very long texts are scanned whole.  No shuffle.
    """
    items = tuple(templates.items())

    def make() -> Callable:
        index = _index(items)

        def work(texts: list[str], _: list) -> Iterator[tuple[int, tuple]]:
            for i, text in enumerate(texts):
                for m in matches(text, index, min_coverage):
                    yield i, m

        return work

    return flat_map_texts(docs, [id_col], text_col, make, SCHEMA)


REPORT = "n_licenses long, best_coverage double, spans string"


def licence_report(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, how many licence texts it holds, the best coverage, and all spans by place.

    Spans read license:start:stop, comma-joined.  A row without any (null and empty texts too) has 0, 0.0
    and an empty string; rows that share an id are reported each by itself; a null id is kept; an empty
    table gives no rows; other columns are not read.  Whole texts are scanned, in the pass that reads them.
    """
    items = tuple(templates.items())

    def make() -> Callable:
        index = _index(items)

        def work(texts: list[str], _: list) -> list[tuple]:
            out = []
            for text in texts:
                found = matches(text, index, min_coverage)
                out.append((len(found), max((c for _, _, c, _, _ in found), default=0.0), ",".join(f"{name}:{a}:{b}" for name, _, _, a, b in found)))
            return out

        return work

    return map_texts(docs, [id_col], text_col, make, REPORT)
