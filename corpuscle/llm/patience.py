"""Licence scans by patience alignment.

Texts and templates are sequences of words. Words that occur once in both are anchors; the longest increasing
subsequence of their places is kept, and the gaps between anchors are aligned in the same way, after equal words at
both ends of a gap have been paired. Coverage is the share of a template's words that are paired.

A document is not aligned as a whole, as a notice may stand in it more than once: each word that is unique in a template
votes for the place where the template would begin, and windows with enough votes are aligned. Windows may lie anywhere
in a text of any length. Words that are put in or left out move the place that later words vote for: a copy is met if
these places lie within a quarter of the template's words of each other (three at least); one that is stretched more
may be missed, although it would align. A notice is reported from `coverage` (0.8) on; of overlapping ones of a template the best.

Rows: null and empty texts have no notices and so no rows; repeated rows are scanned each on its own; equal coverage
goes to the shorter, then the earlier place. An empty table gives an empty table. Only the key and text columns are
read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

# Short notices, the permission texts of common licences, and their whole texts.
_MIT_DISCLAIMER = (
    "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, "
    "fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other "
    "liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings "
    "in the Software."
)
_BSD_DISCLAIMER = (
    "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the "
    "implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be "
    "liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute "
    "goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict "
    "liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_ISC_DISCLAIMER = (
    "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability "
    "and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from "
    "loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or "
    "performance of this software."
)
TEMPLATES = {
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0",
    "mit-notice": "Released under the MIT License",
    "apache-2-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
}
TEMPLATES |= {
    "mit-full": f"{TEMPLATES['mit']} {_MIT_DISCLAIMER}",
    "isc-full": f"{TEMPLATES['isc']} {_ISC_DISCLAIMER}",
    "bsd-2-clause-full": f"{TEMPLATES['bsd-2-clause']} {_BSD_DISCLAIMER}",
    "bsd-3-clause-full": f"{TEMPLATES['bsd-2-clause']} {_BSD_THIRD} {_BSD_DISCLAIMER}",
    "mpl-2-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "lgpl-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser "
        "General Public License for more details."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
        "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
}

_WORD = re.compile(r"[^\W_]+").findall


def words(text: str | None) -> list[str]:
    return _WORD((text or "").lower())


def longest_rising(numbers: Sequence[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by piles of cards."""
    tops: list[int] = []
    ends: list[int] = []
    below = [-1] * len(numbers)
    for i, x in enumerate(numbers):
        pile = bisect_left(tops, x)
        below[i] = ends[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(x)
            ends.append(i)
        else:
            tops[pile], ends[pile] = x, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs of places with equal words, rising in both."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1)}
        anchors = [(i, at[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and in_b.get(a[i]) == 1]
        kept = [anchors[k] for k in longest_rising([j for _, j in anchors])]
        if not kept:
            continue
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)], strict=True):
            todo.append((i + 1, k, j + 1, m))
        pairs += kept
    return sorted(pairs)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = 0.8):
        self.coverage = coverage
        self.names = sorted(templates)
        self.templates = [words(templates[n]) for n in self.names]
        self._votes: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self._need: list[int] = []
        for t, own in enumerate(self.templates):
            counts = Counter(own)
            unique = [j for j, w in enumerate(own) if counts[w] == 1]
            for j in unique:
                self._votes[own[j]].append((t, j))
            # As many words may be missing as the coverage allows, and all of them may be unique ones.
            self._need.append(max(1, len(unique) - int((1 - coverage) * len(own) + 1e-9)))

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, float]]:
        """(template, first word, words, paired, coverage) of each notice, by template and place."""
        own, votes = words(text), self._votes
        cast: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, w in enumerate(own):
            for t, j in votes.get(w, ()):
                cast[t].append((i - j, j))
        out = []
        for t, starts in cast.items():
            if len(starts) >= self._need[t]:
                out += self._notices(t, own, starts)
        return sorted(out)

    def _notices(self, t: int, own: list[str], starts: list[tuple[int, int]]) -> list[tuple[str, int, int, int, float]]:
        template = self.templates[t]
        slack = max(3, len(template) // 4)
        by: dict[int, set[int]] = defaultdict(set)
        for s, j in starts:
            by[s // slack].add(j)
        voted = {s for s, _ in starts}
        found = set()
        for k in by:
            if len(by[k] | by.get(k + 1, set())) < self._need[t]:
                continue
            first, last = max(0, (k - 1) * slack), min(len(own), (k + 3) * slack + len(template))
            windows = {(first, last)}
            near = [j for i in range(k - 2 - len(template) // slack, k + 4 + len(template) // slack) for j in by.get(i, ())]
            # Words of a neighbouring copy are no anchors; the voted starts of a copy's first and last words cut it out.
            if len(near) > len(set(near)):
                begins = [s for s in range(k * slack, (k + 2) * slack) if s in voted]
                windows |= {(max(0, s), min(len(own), e + len(template))) for s in begins for e in begins if abs(e - s) <= slack}
            for first, last in windows:
                pairs = align(own[first:last], template)
                share = len(pairs) / len(template)
                if pairs and share >= self.coverage:
                    begin, end = first + pairs[0][0], first + pairs[-1][0] + 1
                    found.add((-share, begin, end, len(pairs)))
        kept: list[tuple[float, int, int, int]] = []
        for x in sorted(found, key=lambda x: (x[0], x[2] - x[1], x[1])):
            if all(x[2] <= y[1] or x[1] >= y[2] for y in kept):
                kept.append(x)
        return [(self.names[t], begin, end - begin, n, -share) for share, begin, end, n in kept]


def scan(df: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, license, first_word, n_words, n_paired, coverage) of the notices in each text."""
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, coverage)
        for b in batches:
            rows, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = scanner.scan(t)
                rows += [i] * len(found)
                out += found
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], [key, "license", "first_word", "n_words", "n_paired", "coverage"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, license string, first_word long, n_words long, n_paired long, coverage double")
