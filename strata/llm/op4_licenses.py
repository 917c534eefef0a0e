"""License scans: winnowed template fingerprints, then banded alignment.

Words are runs of letters, digits and non-ASCII characters with A-Z folded.  Of
each template and each text every ``GRAM``-word run is hashed and every
``WINDOW`` consecutive hashes keep their least, so a shared run of
``GRAM + WINDOW - 1`` words shares a fingerprint.  The templates' fingerprints
form an inverted index (fingerprint -> template, place).  Hits of one template
on one diagonal (place in text less place in template) form runs; runs that
follow each other in text and template, with no more words between them than
the template has (twice as many in all), are chained.  A chain is aligned with the template word by
word in the band from its lowest to its highest diagonal and ``BAND`` (a quarter
of a short template) on both sides, and is reported if the alignment matches
``COVERAGE`` of the template's words: words put in anywhere, or at the head of
every line, do not hide a template.  Of overlapping reports the one of more
matched words stays.

Scale: the index is small and fixed, so a text is scanned where it lies, in
numpy; only texts with hits reach the alignment, and a chain in whose band too
few of the template's words occur is not aligned.

Cases: a null or wordless text has no licenses; rows that repeat and null ids
are kept; ties go to the name that sorts first; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strata.llm.textvec import buffers, row_groups, windows, words

GRAM, WINDOW, BAND, COVERAGE = 3, 3, 8, 0.8
MATCH, CHANGED, PUT_IN = 8, -8, -1  # a template word left out costs as much as one changed

#: Public license texts and notices, copyright lines left out.
TEMPLATES = {
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
        ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor
        the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
        permission.""",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


def marks(h: np.ndarray) -> np.ndarray:
    """The fingerprint of the window that starts at each word."""
    g = windows(h, GRAM)
    n = len(g) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = g[:n].copy()
    for j in range(1, WINDOW):
        np.minimum(out, g[j: j + n], out=out)
    return out


class Index:
    """Templates as word hashes, and fingerprint -> [(template, place)]."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        data, off = buffers(pa.array([templates[n] for n in self.names], pa.string()))
        h, at, _, _ = words(data, off)
        self.words = [h[at[i]: at[i + 1]] for i in range(len(self.names))]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, w in enumerate(self.words):
            for p, m in enumerate(marks(w).tolist()):
                self.places[m].append((i, p))
        self.marks = np.array(sorted(self.places), np.uint64)


def align(a: np.ndarray, t: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Best local alignment of template ``t`` in ``a`` within ``band`` of a
    diagonal: (matched words, first and last + 1 matched place in ``a``).  A match
    scores ``MATCH``, a word changed or left out ``CHANGED``, one put in
    ``PUT_IN``; of equal scores the one of more matches, then the one that ends
    first in the template."""
    lo, width = diagonal - band, 2 * band + 1
    unit, one = 1 << 44, 1 << 24  # score, matches and first place share one number, so that a maximum carries all three
    place = np.arange(width)
    slope = place * (-PUT_IN * unit)
    above = np.zeros(width + 1, np.int64)
    best, out = 0, (0, 0, 0)
    for i in range(len(t)):
        j = place + (i + lo)
        same = np.zeros(width, bool)
        x, y = max(0, -(i + lo)), min(width, len(a) - i - lo)
        if x < y:
            same[x:y] = a[i + lo + x: i + lo + y] == t[i]
        begun = np.where(above[:-1] > 0, above[:-1], one - 1 - (j - lo))
        row = np.where(same, begun + (MATCH * unit + one), above[:-1] + CHANGED * unit)
        row = np.maximum(row, above[1:] + CHANGED * unit)
        row = np.maximum.accumulate(row + slope) - slope
        row[row < unit] = 0
        c = int(np.argmax(np.where(same, row, 0)))
        if same[c] and row[c] >> 24 > best:
            best = int(row[c]) >> 24
            out = (best & ((1 << 20) - 1), one - 1 - int(row[c]) % one + lo, int(j[c]) + 1)
        above[:-1] = row
    return out


def chains(hits: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Lowest and highest diagonal of each chain of (place in text, place in
    template) hits; every hit is in one chain."""
    runs: list[list[int]] = []  # diagonal, first and last place in the template, hits
    for d, q in sorted((p - q, q) for p, q in hits):
        if runs and runs[-1][0] == d and q - runs[-1][2] <= BAND:
            runs[-1][2], runs[-1][3] = q, runs[-1][3] + 1
        else:
            runs.append([d, q, q, 1])
    runs.sort(key=lambda r: (r[0] + r[1], r[1]))
    value: list[tuple[int, int]] = []  # hits, less diagonals crossed
    before: list[int | None] = []
    start, gap = 0, length + GRAM + WINDOW  # a hit covers so many words itself, less one
    for s, (d, q, _, n) in enumerate(runs):
        while runs[start][0] + runs[start][1] < d + q - gap - length:
            start += 1
        top, frm = (0, 0), None
        for r in range(start, s):
            e, _, z, _ = runs[r]
            crossed = value[r][1] - abs(d - e)
            if z < q and e + z < d + q <= e + z + gap and crossed >= -2 * length and (value[r][0], crossed) > top:
                top, frm = (value[r][0], crossed), r
        value.append((top[0] + n, top[1]))
        before.append(frm)
    used, out = [False] * len(runs), []
    for s in sorted(range(len(runs)), key=lambda s: (-value[s][0], -value[s][1], s)):
        diagonals, r = [], s
        while r is not None and not used[r]:
            used[r] = True
            diagonals.append(runs[r][0])
            r = before[r]
        if diagonals:
            out.append((min(diagonals), max(diagonals)))
    return out


def found_in(h: np.ndarray, index: Index, hits: np.ndarray, fingerprints: np.ndarray) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, last word + 1) in one text."""
    by: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for p, m in zip(hits.tolist(), fingerprints.tolist(), strict=True):
        for i, q in index.places[m]:
            by[i].add((p, q))
    reports = set()
    for i, places in by.items():
        t = index.words[i]
        side = min(BAND, -(-len(t) // 4))
        done: list[tuple[int, int]] = []
        for lo, hi in chains(list(places), len(t)):
            near = bisect_left(done, (lo + side + 1,))
            if near and done[near - 1][0] <= lo + side and hi <= done[near - 1][1] + side:
                continue  # in the band of a better chain, which has been aligned
            insort(done, (lo, hi))
            middle, band = (lo + hi) // 2, (hi - lo + 1) // 2 + side
            if np.isin(t, h[max(0, middle - band): max(0, middle + band + len(t))]).sum() < COVERAGE * len(t):
                continue
            matched, first, end = align(h, t, middle, band)
            if matched >= COVERAGE * len(t):
                reports.add((matched, index.names[i], matched / len(t), first, end))
    out: list[tuple[str, float, int, int]] = []
    ends: list[tuple[int, int]] = []
    for _, name, coverage, first, end in sorted(reports, key=lambda r: (-r[0], r[1], r[3])):
        at = bisect_left(ends, (first, end))
        if (at == 0 or ends[at - 1][1] <= first) and (at == len(ends) or end <= ends[at][0]):
            ends.insert(at, (first, end))
            out.append((name, coverage, first, end))
    return sorted(out, key=lambda o: o[2])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_licenses`` and ``licenses``, an
    array of (license, coverage, start, end) with code point spans."""
    index = Index(TEMPLATES if templates is None else templates)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        index = shared.value
        for b in batches:
            data, off = buffers(b.column(text_col))
            out: list[list[dict]] = []
            for i, j in row_groups(off, 1 << 20):
                h, at, s, e = words(data, off[i: j + 1])
                m = marks(h)
                place = np.minimum(np.searchsorted(index.marks, m), max(len(index.marks) - 1, 0))
                hit = np.flatnonzero(index.marks[place] == m) if len(index.marks) else np.zeros(0, int)
                row = np.searchsorted(at, hit, "right") - 1
                inside = hit + GRAM + WINDOW - 1 <= at[row + 1] if len(hit) else hit
                hit, row = (hit[inside], row[inside]) if len(hit) else (hit, hit)
                own: list[list[dict]] = [[] for _ in range(j - i)]
                for r in np.unique(row):
                    mine = hit[row == r]
                    base = int(at[r])
                    for name, coverage, first, end in found_in(h[base: at[r + 1]], index, mine - base, m[mine]):
                        lo, x, y = int(off[i + r]), int(s[base + first]), int(e[base + end - 1])
                        start = len(data[lo:x].tobytes().decode("utf-8", "replace"))
                        own[r].append({"license": name, "coverage": coverage, "start": start,
                                       "end": start + len(data[x:y].tobytes().decode("utf-8", "replace"))})
                out += own
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(list(map(len, out)), pa.int64()), pa.array(out, kind)],
                                             [id_col, "n_licenses", "licenses"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].cast("string").alias(text_col)).mapInArrow(
        run, f"`{id_col}` {id_type}, n_licenses long, licenses array<struct<license: string, coverage: double, start: long, end: long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.selectExpr("doc_id", "n_licenses",
                          "array_join(transform(licenses, x -> concat_ws(':', x.license, x.start, x.end)), ',') AS licenses",
                          "coalesce(array_max(transform(licenses, x -> x.coverage)), 0D) AS coverage")
