"""License scans by patience alignment of texts with license templates.

A text is seen in stretches of three template lengths, one beginning every template length, so anything up to twice as long as
the template lies within one. In a stretch, words unique to both it and the template are anchors; the longest increasing run of
them is kept, and the gaps between are aligned in the same way (where nothing is unique in a gap, by longest common subsequence).
Of what is aligned, the part counts that holds the most words within a span of at most a quarter (four words at least) more than
the template's, of equal ones the first. Coverage is the share of the template's words in that part.

A template's key words, which tell it from its neighbours, must all be aligned, and none of the words that it is `without` may
be in the span: a notice of the GPL isn't one of the MIT license, however alike they are. Where the spans of two licenses
overlap, the one with the more aligned words over those that aren't has the place. Of a license's spans in a document the one
of the greatest coverage is reported, of equal ones the first. Only texts that have a template's key words are aligned with it,
and of these only stretches that have the words for the threshold in any order, which loses nothing.

Words are runs of letters and digits in ASCII lower case; bytes of other characters are letters. Nulls count as empty texts and
have no license; rows without doc_id are left out. Rows that repeat a doc_id count as one document, reported by its best text.
Columns besides doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlegraph.llm.shared import text_chunks
from spindlegraph.llm.words import LOWER, NOT_ALNUM, Words, words

_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "*Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. *Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in *binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GPL_HEADER = "This program is free software: you can *redistribute it and/or modify it under the terms of the *GNU {0} *Public License as published by the Free Software Foundation, either *version *{1} of the License, or (at your option) any later version."
#: Words marked with * are key words; after " -- " come the words that the template is without.
TEMPLATES = {
    "mit-notice": "Released under the *MIT *License.",
    "mit": "Permission is hereby granted, *free of *charge, to any person obtaining a copy of this *software and associated documentation files (the \"Software\"), to *deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, *sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-grant": "Permission is hereby *granted, *free of *charge, to any person *obtaining a copy",
    "bsd-notice": "Released under the *BSD *License.",
    "bsd-2-clause": _BSD + " " + _AS_IS + " -- endorse",
    "bsd-3-clause": _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to *endorse or promote products derived from this software without specific prior written permission. " + _AS_IS,
    "bsd-clauses": _BSD,
    "isc": "*Permission to use, copy, modify, and/or distribute this software for any purpose *with or *without *fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-2.0-notice": "Licensed under the *Apache *License, *Version *2.0.",
    "apache-2.0-header": "you may *not use this file except in *compliance with the License. You may obtain a copy of the License at http://www.*apache.org/licenses/LICENSE-*2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-notice": "Released under the *GPL *License. -- mit bsd apache",
    **{f"gpl-{v}.0-notice": f"This work is licensed under the *GNU *General *Public *License, *version *{v}. -- lesser library affero" for v in (2, 3)},
    **{f"gpl-{v}.0-header": _GPL_HEADER.format("*General", v) + " -- lesser library affero" for v in (2, 3)},
    **{f"lgpl-{name}-notice": f"This work is licensed under the *GNU *Lesser *General *Public *License, *version *{v}." for name, v in (("2.1", "2.1"), ("3.0", "3"))},
    "agpl-3.0-notice": "This work is licensed under the *GNU *Affero *General *Public *License, *version *3.",
    "agpl-3.0-header": _GPL_HEADER.format("*Affero *General", 3),
    "mpl-2.0": "This Source Code Form is subject to the terms of the *Mozilla *Public *License, v. *2.0.",
    "unlicense": "This is free and *unencumbered software released into the *public *domain.",
    "all-rights-reserved": "*All *rights *reserved.",
    **{f"cc-{kind}-{v}": f"Licensed under *CC *{kind.upper().replace('-', ' *')} *{v}." + (f" -- {' '.join(x for x in ('nc', 'nd', 'sa') if x not in kind.split('-'))}" if kind != "by-nc-nd-sa" else "") for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in ("3.0", "4.0")},
    **{f"cc-{kind}-4.0-notice": f"This work is licensed under a *Creative *Commons *Attribution {' '.join('*' + x for x in names)} *4.0 International *License. -- {' '.join(x for x in ('noncommercial', 'sharealike', 'noderivatives') if x not in names)}" for kind, names in (("by", ()), ("by-sa", ("sharealike",)), ("by-nd", ("noderivatives",)), ("by-nc", ("noncommercial",)), ("by-nc-sa", ("noncommercial", "sharealike")), ("by-nc-nd", ("noncommercial", "noderivatives")))},
}
STRETCH = 3


def plain(template: str) -> str:
    """A template's text without its marks."""
    return template.partition(" -- ")[0].replace("*", "")


def _rising(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence of distinct values."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        tops[k : k + 1], at[k : k + 1] = [v], [i]
        before[i] = at[k - 1] if k else -1
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence, the earliest matches first."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Places (in a, in b) that patience alignment pairs, in order."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        i, k, j, m = gaps.pop()
        if i == k or j == m:
            continue
        in_a, in_b = Counter(a[i:k]), Counter(b[j:m])
        where = {x: q for q, x in enumerate(b[j:m], j) if in_b[x] == 1}
        pairs = [(p, where[x]) for p, x in enumerate(a[i:k], i) if in_a[x] == 1 and x in where]
        if not pairs:
            if in_a.keys() & in_b.keys():
                out += [(i + p, j + q) for p, q in _common(a[i:k], b[j:m])]
            continue
        kept = [pairs[r] for r in _rising([q for _, q in pairs])]
        out += kept
        ends = [(i - 1, j - 1), *kept, (k, m)]
        gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends[:-1], ends[1:])]
    return sorted(out)


def densest(pairs: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """The most of the pairs whose places in the text lie within limit words, of equal ones the first."""
    best, a = (0, 0), 0
    for b in range(len(pairs)):
        while pairs[b][0] - pairs[a][0] >= limit:
            a += 1
        if b + 1 - a > best[1] - best[0]:
            best = a, b + 1
    return pairs[best[0] : best[1]]


class Template:
    """words, and the places of key words among them; without: hashes of words that may not be in a span."""

    def __init__(self, text: str):
        text, _, without = text.partition(" -- ")
        marked = re.findall("\\*?[A-Za-z0-9\x80-\U0010ffff]+", text)
        w = words(pa.array([plain(m) for m in marked], pa.string()), LOWER, NOT_ALNUM)
        self.words, self.size = w.hash.tolist(), len(w.hash)
        if not self.size:
            raise ValueError("a template needs words")
        is_key = np.array(["*" in m for m in marked])[w.row]
        self.key_places = set(np.flatnonzero(is_key).tolist())
        self.keys = np.unique(w.hash[is_key])
        self.without = set(words(pa.array([without]), LOWER, NOT_ALNUM).hash.tolist())
        self.known, self.often = np.unique(w.hash, return_counts=True)
        self.limit = self.size + max(4, self.size // 4)

    def stretches(self, w: Words, rows: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
        """(text, first word, end) of the stretches of these texts that have the words for the threshold."""
        many = w.count[rows]
        at = np.repeat(w.first[rows], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        k = np.minimum(np.searchsorted(self.known, w.hash[at]), len(self.known) - 1)
        is_known = self.known[k] == w.hash[at]
        hit, kind = at[is_known], k[is_known]
        if not len(hit):
            return []
        row = w.row[hit]
        block = (hit - w.first[row]) // self.size
        found = []
        for back in range(STRETCH):
            of = block >= back
            found.append(np.stack([row[of], block[of] - back, kind[of]], 1))
        key = np.concatenate(found)
        key = key[np.lexsort((key[:, 2], key[:, 1], key[:, 0]))]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        has = np.minimum(np.diff(np.append(new, len(key))), self.often[key[new, 2]])
        key = key[new, :2]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        enough = np.add.reduceat(has, first) >= threshold * self.size - 1e-9
        return [(r, int(w.first[r]) + b * self.size, min(int(w.first[r]) + (b + STRETCH) * self.size, int(w.first[r + 1]))) for r, b in key[first[enough]].tolist()]

    def span(self, text: list[int], threshold: float) -> tuple[int, int, int] | None:
        """(first word, end, aligned words) of the template in a stretch, if it is there."""
        pairs = densest(aligned(text, self.words), self.limit)
        if len(pairs) < threshold * self.size - 1e-9 or not self.key_places <= {q for _, q in pairs}:
            return None
        a, b = pairs[0][0], pairs[-1][0] + 1
        return None if self.without and not self.without.isdisjoint(text[a:b]) else (a, b, len(pairs))


def chosen(spans: list[tuple[int, int, int, int, str]]) -> dict[str, tuple[float, int, int]]:
    """(coverage, first word, end) by license, of one text's spans (first word, end, aligned words, template's words, license); of overlapping ones of two licenses the better has the place."""
    cell = max((s[1] - s[0] for s in spans), default=1)
    taken: dict[int, list[tuple[int, int, str]]] = {}  # by the cell that each begins in
    best: dict[str, tuple[float, int, int]] = {}
    for a, b, n, size, name in sorted(set(spans), key=lambda s: (s[1] - s[0] - 2 * s[2], -s[2] / s[3], s[0], s[1], s[4])):
        if any(a < d and c < b and name != other for k in range(a // cell - 1, b // cell + 1) for c, d, other in taken.get(k, ())):
            continue
        taken.setdefault(a // cell, []).append((a, b, name))
        if name not in best or (-n / size, a, b) < (-best[name][0], *best[name][1:]):
            best[name] = n / size, a, b
    return best


def _scan(templates: Mapping[str, str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(name, Template(text)) for name, text in templates.items()]
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t.keys for _, t in made)]))
        wanted = [np.searchsorted(keys, t.keys) for _, t in made]
        for chunk in text_chunks(batches):
            w, ids = words(chunk.column(1), LOWER, NOT_ALNUM), chunk.column(0).to_pylist()
            has = np.zeros((len(ids), len(keys)), bool)
            if len(keys):
                k = np.minimum(np.searchsorted(keys, w.hash), len(keys) - 1)
                is_key = keys[k] == w.hash
                has[w.row[is_key], k[is_key]] = True
            spans: dict[int, list[tuple[int, int, int, int, str]]] = {}
            for (name, t), at in zip(made, wanted):
                rows = np.flatnonzero(has[:, at].all(1))
                for row, a, b in t.stretches(w, rows, threshold) if len(rows) else ():
                    if (found := t.span(w.hash[a:b].tolist(), threshold)) is not None:
                        base = a - int(w.first[row])
                        spans.setdefault(row, []).append((base + found[0], base + found[1], found[2], t.size, name))
            rows = [(ids[row], name, *v) for row, some in spans.items() for name, v in chosen(some).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "license", "coverage", "start_word", "end_word"])

    return run


def licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(doc_id, license, coverage, start_word, end_word) of every license that covers threshold or more of its template in a document."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_scan(templates, threshold), "doc_id long, license string, coverage double, start_word long, end_word long")
    best = F.min(F.struct((-F.col("coverage")).alias("c"), "start_word", "end_word"))
    return found.groupBy("doc_id", "license").agg(best.alias("b")).select("doc_id", "license", F.round(-F.col("b.c"), 6).alias("coverage"), "b.start_word", "b.end_word")
