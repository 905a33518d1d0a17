"""License scan by patience alignment.

A template and a stretch of text are aligned on the words that occur once in both: the longest increasing subsequence of
their places is kept, and the gaps between its anchors are aligned in the same way until a gap has no such word; then
equal words are taken from both ends of the gap. Coverage is the share of the template's words that are aligned. A text
holds a license if a stretch of at most SPREAD times the template's words covers LEAST of it or more.

Words of the text that the template lacks can't be aligned and are left out beforehand, so comment marks or words put in
between cost nothing. Stretches: an alignment that covers LEAST of the template holds at least one of any
(1 - LEAST) * words + 1 of its words. Places of the rarest of them say where the template would begin; places that lie
near each other give a stretch, at three widths (slips of the words that may be missing, of the template's length, and of
SPREAD times that) and, last, as one stretch from the first to the last. The best of all counts.

Coverage alone would let the one word go that tells a license from its neighbours. So versions, names and kinds of
licenses and negations are required words: a stretch counts only if all of the template's are aligned, if no other version
stands between a version and the word before it, if no kind (as lesser, affero) stands among at most two words put in, and
if the notice isn't negated ("not licensed under"). 2.0 and 2 are the same version.

Defined cases: null text counts as empty and holds nothing; a document with several licenses names each; a template that
occurs more than once counts once, at its best place (the first among equals); of licenses whose stretches overlap, the
better covered stays, then the longer, then the first by name; repeated rows are scanned once each; an empty table gives
an empty result; a column licenses of the input is replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

# The wording of license notices and short licenses, as their owners publish it.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Artistic-2.0": "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "ISC-opening": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License",
    "MIT-opening": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
}
LEAST, SPREAD = 0.85, 8
# Words that name a license, words that make it another kind, and negations.
NAMES = frozenset(b"apache artistic attribution boost creative eclipse gnu mit mozilla".split())
KINDS = frozenset(b"affero lesser noncommercial sharealike noderivatives noderivs by-nc by-sa attribution-noncommercial attribution-sharealike attribution-noderivatives attribution-noderivs".split())
NEGATIONS = frozenset(b"no not neither nor".split())
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if chr(c) in "()\"',;:!?<>[]{}*#|\t\n\r\v\f" else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words without the punctuation around them, and without .0 at their end."""
    return [w for w in (x.strip(b".").removesuffix(b".0") for x in text.translate(_FOLD).split()) if w]


def is_version(word: bytes) -> bool:
    return word.replace(b".", b"").isdigit()


def rising(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (patience sorting)."""
    tops, top_at, back = [], [], []
    for i, p in enumerate(places):
        pile = bisect_left(tops, p)
        back.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(p)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = p, i
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(left: tuple | list, right: tuple | list, a: int = 0, b: int | None = None, c: int = 0, d: int | None = None) -> list[tuple[int, int]]:
    """Pairs of places of equal words in left[a:b] and right[c:d], rising in both."""
    b, d = len(left) if b is None else b, len(right) if d is None else d
    out, tail = [], []
    while a < b and c < d and left[a] == right[c]:
        out.append((a, c))
        a, c = a + 1, c + 1
    while a < b and c < d and left[b - 1] == right[d - 1]:
        b, d = b - 1, d - 1
        tail.append((b, d))
    if a < b and c < d:
        here, there = Counter(left[a:b]), Counter(right[c:d])
        at = {w: j for j, w in enumerate(right[c:d], c) if there[w] == 1}
        once = [(i, at[w]) for i, w in enumerate(left[a:b], a) if here[w] == 1 and w in at]
        i, j = a, c
        for x, y in [once[k] for k in rising([p[1] for p in once])]:
            out += [*align(left, right, i, x, j, y), (x, y)]
            i, j = x + 1, y + 1
        if i > a:
            out += align(left, right, i, b, j, d)
    return out + tail[::-1]


class Template:
    """A license's words, how often each occurs, how many may be missing, and places of those that may not."""

    def __init__(self, text: str):
        self.words = tuple(words_of(text.encode()))
        self.count = Counter(self.words)
        self.known = frozenset(self.words)
        self.size = len(self.words)
        self.spare = int(self.size * (1 - LEAST))
        self.required = [i for i, w in enumerate(self.words) if is_version(w) or w in NAMES or w in KINDS or w in NEGATIONS]
        self.needed = frozenset(self.words[i] for i in self.required)

    def possible(self, vocabulary: set[bytes]) -> bool:
        return self.needed <= vocabulary and sum(self.count[w] for w in self.known - vocabulary) <= self.spare

    def agrees(self, text: list[bytes], pairs: list[tuple[int, int]]) -> bool:
        """Do the aligned pairs hold all required words, and is nothing put in that makes it another license?"""
        if not {i for i, _ in pairs}.issuperset(self.required):
            return False
        i, p = pairs[0]
        if i == 0 and p and text[p - 1] == b"not":
            return False
        for j, q in pairs[1:]:
            if q > p + 1:
                if is_version(self.words[j]) and j == i + 1 and is_version(text[p + 1]):
                    return False
                between = text[p + 1 : q] if q <= p + 3 else []
                if any(w in KINDS for w in between) or between == [b"not"]:
                    return False
            i, p = j, q
        return True


def _clusters(places: list[int], slip: int) -> list[tuple[int, int]]:
    """First and last of each run of rising places no more than slip apart."""
    out: list[tuple[int, int]] = []
    for p in places:
        if out and p - out[-1][1] <= slip:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


def _densest(pairs: list[tuple[int, int]], most: int) -> tuple[int, int, int]:
    """How many pairs at most lie in a stretch of so many words, and the stretch (the first among equals), end exclusive."""
    best, i = (0, 0, 0), 0
    for j, (_, at) in enumerate(pairs):
        while at - pairs[i][1] >= most:
            i += 1
        if j - i + 1 > best[0]:
            best = (j - i + 1, pairs[i][1], at + 1)
    return best


def find(text: list[bytes], template: Template, where: dict[bytes, list[int]]) -> tuple[float, int, int]:
    """Best coverage of the template by a stretch of text that agrees with it, and the stretch in words, end exclusive."""
    size, words = template.size, template.words
    places = sorted(p for w in template.known for p in where.get(w, ()))
    kept = [text[p] for p in places]
    keys = sorted(range(size), key=lambda i: (len(where.get(words[i], ())), i))[: template.spare + 1]
    starts = sorted({p - i for i in keys for p in where.get(words[i], ())})
    best, tried = (0, 0, 0), set()
    for slip in (template.spare + 2, size, (SPREAD - 1) * size, len(text) + size):
        for first, last in _clusters(starts, slip):
            a, b = bisect_left(places, first - slip), bisect_left(places, last + size + slip)
            if b - a <= best[0] or b - a < size - template.spare or (a, b) in tried:
                continue
            tried.add((a, b))
            pairs = [(i, places[a + j]) for i, j in align(words, kept[a:b])]
            n, start, end = _densest(pairs, SPREAD * size)
            if n > best[0] and template.agrees(text, [x for x in pairs if start <= x[1] < end]):
                best = (n, start, end)
        if best[0] == size:
            break
    return best[0] / size, best[1], best[2]


def scan(text: bytes, known: dict[str, Template]) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) of each template that the text covers to LEAST at least, best first; of stretches that overlap, the best stays."""
    words = words_of(text)
    vocabulary, found, where = set(words), [], None
    for name, template in known.items():
        if not template.size or not template.possible(vocabulary):
            continue
        if where is None:
            where = {}
            for i, w in enumerate(words):
                where.setdefault(w, []).append(i)
        share, a, b = find(words, template, where)
        if share >= LEAST:
            found.append((name, share, a, b))
    found.sort(key=lambda x: (-x[1], -known[x[0]].size, x[0]))
    return [x for i, x in enumerate(found) if not any(x[2] < b and a < x[3] for _, _, a, b in found[:i])]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """docs and a struct column licenses: found (each license with coverage and place in words), license (the best), coverage. templates: texts by name, a catalogue that every task holds."""
    texts_of = TEMPLATES if templates is None else templates

    @F.pandas_udf("found array<struct<license:string,coverage:double,start:int,end:int>>, license string, coverage double")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = {name: Template(text) for name, text in texts_of.items()}
        for texts in batches:
            rows = []
            for text in texts:
                found = scan(text, known)
                best = found[0] if found else (None, 0.0)
                rows.append(([{"license": n, "coverage": c, "start": a, "end": b} for n, c, a, b in found], best[0], best[1]))
            yield pd.DataFrame(rows, columns=["found", "license", "coverage"])

    return docs.withColumn("licenses", scanned(text_bytes()))
