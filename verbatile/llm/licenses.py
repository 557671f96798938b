"""License scans by patience alignment.

A document is compared with each license template: words that are unique in both texts are anchors, the longest increasing
subsequence of their places is kept, and the gaps between neighbouring anchors are aligned in the same way until nothing is
left to match; a gap in which words repeat but none is unique gets a longest common subsequence. Coverage is the share of the
template's words that are matched.

A match may be spread over at most SPREAD times as many words as the template has. Where it can be is found for all texts at
once: stretches of that length with enough words of the template. Only those are aligned, in overlapping windows that hold every
possible match, however often a notice stands in a text; the best window counts. As coverage can't exceed the share of the
template's words that a stretch has, nothing is lost.

Words are runs of ASCII letters and digits, compared in lower case; all other characters separate them.

Edge cases: null and empty texts have no license; equal coverage goes to the longer template, then to the name that comes
first, of one license's matches to the first; repeated rows get equal results; an empty table gives an empty one; extra columns
are not read, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, Words, slices

#: Least share of a template's words for a license to be reported, and how far a match may be spread.
MIN_COVERAGE, SPREAD = 0.8, 2
WORD = re.compile(r"[A-Za-z0-9]+")
#: All bytes but ASCII letters and digits.
NOT_WORD = np.array([b >= 128 or not chr(b).isalnum() for b in range(256)])

# Notices and texts of licenses in use; README lists what is not among them.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "BSL-1.0": 'Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)',
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is dedicated to the public domain under CC0 1.0 Universal.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back[i] = ends[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common_subsequence(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of a longest common subsequence, by the plain table; words that only one side has are left out first."""
    both = set(a) & set(b)
    rows, columns = [i for i, w in enumerate(a) if w in both], [j for j, w in enumerate(b) if w in both]
    table = [[0] * (len(columns) + 1)]
    for i in rows:
        above, row = table[-1], [0]
        for k, j in enumerate(columns):
            row.append(above[k] + 1 if a[i] == b[j] else max(above[k + 1], row[k]))
        table.append(row)
    out, i, k = [], len(rows), len(columns)
    while i and k:
        if a[rows[i - 1]] == b[columns[k - 1]]:
            i, k = i - 1, k - 1
            out.append((rows[i], columns[k]))
        elif table[i - 1][k] >= table[i][k - 1]:
            i -= 1
        else:
            k -= 1
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (in a, in b), rising in both. A stack takes the place of recursion."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        # What stands at either end of a gap on both sides touches matched words and matches too.
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        unique = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        anchors = [unique[k] for k in longest_increasing([j for _, j in unique])]
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in common_subsequence(a[a0:a1], b[b0:b1])]
            continue
        out += anchors
        last = (a0 - 1, b0 - 1)
        for here in [*anchors, (a1, b1)]:
            if here[0] - last[0] > 1 and here[1] - last[1] > 1:
                todo.append((last[0] + 1, here[0], last[1] + 1, here[1]))
            last = here
    return sorted(out)


class Templates:
    """The templates' words as numbers, and how to find where a text may hold one."""

    def __init__(self, texts: dict[str, str], min_coverage: float):
        self.min_coverage, self.names = min_coverage, sorted(texts)
        cut = {name: [w.lower() for w in WORD.findall(texts[name])] for name in self.names}
        words = sorted({w for t in cut.values() for w in t})
        hashes = Words(pa.array(words, pa.string()), spaces=NOT_WORD).hashes() if words else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, place = hashes[order], {words[k]: i for i, k in enumerate(order)}
        self.words = [[place[w] for w in cut[name]] for name in self.names]
        self.least = [max(1, int(np.ceil(min_coverage * len(t) - 1e-9))) for t in self.words]
        self.known = np.zeros(1 << 16, dtype=bool)
        self.known[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.has = [np.isin(np.arange(len(words)), t) for t in self.words]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if no template has it."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.known[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            out[maybe] = np.where(self.hashes[at] == hashes[maybe], at, -1)
        return out

    def stretches(self, t: int, place: np.ndarray, number: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, first, end) of the stretches that may hold a match of template t. place, number, text: of all known words."""
        mine = self.has[t][number]
        at, of, k, span = place[mine], text[mine], self.least[t], SPREAD * len(self.words[t])
        if len(at) < k:
            return []
        first = np.flatnonzero((of[k - 1 :] == of[: len(of) - k + 1]) & (at[k - 1 :] - at[: len(at) - k + 1] < span))
        out: list[tuple[int, int, int]] = []
        for i in first.tolist():
            lo, hi, doc = int(at[i + k - 1]) - span + 1, int(at[i]) + span, int(of[i])
            if out and out[-1][0] == doc and lo <= out[-1][2]:
                out[-1] = (doc, out[-1][1], max(hi, out[-1][2]))
            else:
                out.append((doc, lo, hi))
        return out

    def best(self, t: int, words: list[int]) -> tuple[float, int, int] | None:
        """Coverage of template t in its best window of a stretch, and that match's first word and end there."""
        template, least, found = self.words[t], self.least[t], None
        need = Counter(template)
        size = len(template)
        for lo in range(0, max(1, len(words) - SPREAD * size + 1 + size - 1), size):
            window = words[lo : lo + (SPREAD + 1) * size]
            have = Counter(window)
            if sum(min(n, have[w]) for w, n in need.items()) < least:
                continue
            pairs = patience(template, window)
            if len(pairs) >= least and (found is None or len(pairs) > found[0]):
                found = (len(pairs), lo + pairs[0][1], lo + pairs[-1][1] + 1)
                if len(pairs) == size:
                    break
        return (found[0] / size, found[1], found[2]) if found else None

    def scan(self, texts: pa.Array) -> list[list[tuple[str, float, int, int]]]:
        """For each text (license, coverage, first word, end) of every license found, the best first."""
        words = Words(texts, lower=True, spaces=NOT_WORD)
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in words.count]
        number = self.numbers(words.hashes())
        place = np.flatnonzero(number >= 0)
        text = np.searchsorted(words.first, place, side="right") - 1
        for t, name in enumerate(self.names):
            best: dict[int, tuple[float, int, int]] = {}
            for doc, lo, hi in self.stretches(t, place, number[place], text):
                a, b = int(words.first[doc]), int(words.first[doc + 1])
                lo, hi = max(lo, a), min(hi, b)
                hit = self.best(t, number[lo:hi].tolist()) if best.get(doc, (0.0,))[0] < 1 else None
                if hit and (doc not in best or hit[0] > best[doc][0]):
                    best[doc] = (hit[0], lo - a + hit[1], lo - a + hit[2])
            for doc, hit in best.items():
                out[doc].append((name, *hit))
        size = dict(zip(self.names, map(len, self.words), strict=True))
        for found in out:
            found.sort(key=lambda x: (-x[1], -size[x[0]], x[0]))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, license and coverage of the best match (null and 0), its words [first_word, end_word), and
    licenses, all that were found. One pass without a shuffle."""
    own = Templates(templates, min_coverage)
    schema = "doc_id bigint, license string, coverage double, first_word bigint, end_word bigint, licenses array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = own.scan(part.column(1))
                best = [f[0] if f else (None, 0.0, None, None) for f in found]
                columns = [pa.array([b[k] for b in best], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array([[x[0] for x in f] for f in found], pa.list_(pa.string()))], ["doc_id", "license", "coverage", "first_word", "end_word", "licenses"])

    return docs.select(F.col(id_col).cast("bigint").alias(P + "id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
