"""License scan by patience alignment.

A text's words are aligned with those of license templates: words unique to both sides are anchors, the longest
increasing subsequence of their places is kept, and the gaps between kept anchors are aligned in the same way. A
template's coverage is the share of its words that are aligned; it is found where coverage and density are high enough.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

COVERAGE, DENSITY = 0.8, 0.5
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

# The texts of the licenses' own notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "mit": "Released under the MIT License.",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/""",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
COMMON = set("a an and any are as at be but by for from if in is it may not of on or that the this to under with you your".split())


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of equal words, increasing on both sides."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        place: dict[str, list[int]] = {}
        for side, (words, lo, hi) in enumerate(((a, a0, a1), (b, b0, b1))):
            for i in range(lo, hi):
                entry = place.setdefault(words[i], [0, 0, -1, -1])
                entry[side] += 1
                entry[2 + side] = i
        anchors = sorted((e[2], e[3]) for e in place.values() if e[0] == e[1] == 1)
        if not anchors:
            continue
        # longest increasing subsequence of the places in b: piles with back links
        tops, ends, back = [], [], [-1] * len(anchors)
        for i, (_, y) in enumerate(anchors):
            k = bisect_left(tops, y)
            back[i] = ends[k - 1] if k else -1
            tops[k : k + 1], ends[k : k + 1] = [y], [i]
        chain, i = [], ends[-1]
        while i >= 0:
            chain.append(anchors[i])
            i = back[i]
        chain.reverse()
        out += chain
        for (x0, y0), (x1, y1) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)]):
            if x0 + 1 < x1 and y0 + 1 < y1:
                work.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(out)


class Template:
    """A template's words and its sentinels: words on so many of its places that coverage can't be reached without one."""

    def __init__(self, name: str, text: str):
        self.name, self.words = name, [w for w, _, _ in words_of(text)]
        need = int((1 - COVERAGE) * len(self.words) + 1e-9) + 1
        self.held = held = Counter(self.words)
        self.places: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            self.places.setdefault(w, []).append(i)
        self.sentinels: set[str] = set()
        for w in sorted(held, key=lambda w: (w in COMMON, -held[w], -len(w), w)):
            if need <= 0:
                break
            self.sentinels.add(w)
            need -= held[w]


_templates: list[Template] = []


def templates() -> list[Template]:
    if not _templates:
        _templates.extend(Template(k, v) for k, v in TEMPLATES.items())
    return _templates


def _regions(at: list[int], reach: int, n: int) -> Iterator[tuple[int, int]]:
    """Stretches of words that hold the sentinels, with room for a template around them."""
    a = b = None
    for i in at:
        if b is not None and i - reach <= b:
            b = min(n, i + reach)
            continue
        if a is not None:
            yield a, b
        a, b = max(0, i - reach), min(n, i + reach)
    if a is not None:
        yield a, b


def _stretch(t: Template, plain: list[str], a: int, b: int) -> tuple[int, int, int] | None:
    """(aligned words, start, end) of the stretch of at most twice the template's length that holds most of the aligned words, if it is a copy."""
    m, pairs_ = len(t.words), patience(t.words, plain[a:b])
    best, j = (0, 0, 0), 0
    for i in range(len(pairs_)):
        while pairs_[i][1] - pairs_[j][1] >= 2 * m:
            j += 1
        best = max(best, (i - j + 1, -j, i))
    held, j, i = best[0], -best[1], best[2]
    if held < COVERAGE * m:
        return None
    s, e = a + pairs_[j][1], a + pairs_[i][1] + 1
    return (held, s, e) if held >= DENSITY * (e - s) else None


def _may_hold(t: Template, have: Counter) -> bool:
    return sum(min(have[w], n) for w, n in t.held.items()) >= COVERAGE * len(t.words)


def _copies(t: Template, plain: list[str], at: list[int], a: int, b: int) -> Iterator[tuple[int, int, int]]:
    """(aligned words, start, end) of the copies of a template in a region.

    Words of several copies are no anchors in the region as a whole. Where a sentinel occurs more often than in the
    template, windows of about its length around each sentinel are aligned too. The copies with most aligned and fewest other words
    are taken, so that none borrows the words of its neighbour.
    """
    m, work = len(t.words), [(a, b)]
    while work:
        a, b = work.pop()
        have = Counter(plain[a:b])
        if not _may_hold(t, have):
            continue
        found = {_stretch(t, plain, a, b)}
        if any(have[w] > t.held[w] for w in t.sentinels):
            own = at[bisect_left(at, a) : bisect_left(at, b)]
            spans = {(max(a, i - p - d), min(b, i - p + m + d)) for i in own for p in t.places[plain[i]] for d in (0, m // 4, m // 2)}
            found |= {_stretch(t, plain, x, y) for x, y in spans if _may_hold(t, Counter(plain[x:y]))}
        taken: list[tuple[int, int, int]] = []
        for c in sorted(found - {None}, key=lambda c: (c[2] - c[1] - 2 * c[0], -c[0], c[1])):
            k = bisect_left(taken, c[1], key=lambda y: y[1])
            if (k == 0 or taken[k - 1][2] <= c[1]) and (k == len(taken) or c[2] <= taken[k][1]):
                taken.insert(k, c)
        yield from taken
        if taken:
            work += [(x, y) for x, y in zip([a, *(c[2] for c in taken)], [*(c[1] for c in taken), b]) if x < y]


def scan(text: str | None) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) of the templates found, the best of those that overlap; code points, end exclusive."""
    low = (text or "").lower()
    near = [t for t in templates() if any(s in low for s in t.sentinels)]
    if not near:
        return []
    words = words_of(text)
    plain = [w for w, _, _ in words]
    place: dict[str, list[int]] = {}
    for i, w in enumerate(plain):
        place.setdefault(w, []).append(i)
    found = []
    for t in near:
        at = sorted(i for s in t.sentinels for i in place.get(s, ()))
        m = len(t.words)
        for a, b in _regions(at, m + m // 2, len(plain)):
            found += [(t.name, held / m, m, words[s][1], words[e - 1][2]) for held, s, e in _copies(t, plain, at, a, b)]
    found.sort(key=lambda x: (-x[2] * x[1], x[3], x[0]))
    kept: list = []
    for x in found:
        if all(x[4] <= y[3] or y[4] <= x[3] for y in kept):
            kept.append(x)
    return sorted([(n, round(c, 4), s, e) for n, c, _, s, e in kept], key=lambda x: (x[2], x[0]))


def licenses(docs: DataFrame) -> DataFrame:
    """A row per license found in docs (doc_id, text): doc_id, license, coverage, start, end.

    Null and empty texts hold none. Rows are independent; repeated rows give repeated results and other columns aren't
    read. Texts are scanned whole: a text without any of a template's sentinels can't reach its coverage, so only the
    others are aligned, in regions around the sentinels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i.as_py(), *x) for i, t in zip(batch.column(0), batch.column(1)) for x in scan(t.as_py())]
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "license", "coverage", "start", "end"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, license string, coverage double, start long, end long")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
