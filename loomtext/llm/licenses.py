"""License notices by patience alignment with templates.

A template is aligned with a stretch of text: common ends are trimmed, words
that are unique in both are anchors, the longest increasing run of anchors
stays, and the gaps between them are aligned in the same way. The share of the
template's words that are aligned is its coverage.

Which stretches are worth an alignment is decided exactly: coverage can't
exceed the share of template words that a stretch holds at all.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import kernel as K
from loomtext.llm.common import mapped, text_column

COVERAGE, STRETCH, SLACK = 0.85, 1.5, 4

#: (license, words that a match must hold, text)
TEMPLATES: list[tuple[str, str, str]] = [
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Licensed under the MIT license."),
    ("MIT", "mit", "This project is licensed under the terms of the MIT license."),
    ("MIT", "spdx mit", "SPDX-License-Identifier: MIT"),
    ("MIT", "permission", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "spdx apache 2", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "apache 2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "gnu 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "gnu 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "gnu 3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("BSD-3-Clause", "bsd", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "redistributions", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may
be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("ISC", "permission", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    ("MPL-2.0", "mozilla 2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("CC-BY-4.0", "commons attribution 4", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "commons sharealike 4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "cc0 1", "To the extent possible under law, the author has dedicated this work to the public domain under the CC0 1.0 Universal Public Domain Dedication."),
    ("BSD-2-Clause", "bsd 2", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "redistributions", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""),
    ("LGPL-3.0", "lesser 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "lesser 2 1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "lesser 3", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("LGPL-2.1", "lesser 2 1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("AGPL-3.0", "affero 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "affero 3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL-2.0", "gnu 2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("Unlicense", "unlicense", "Released under the Unlicense."),
    ("Unlicense", "unencumbered", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "boost 1", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "eclipse 2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Zlib", "altered misrepresented", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be
misrepresented; Altered source versions must be plainly marked as such. This notice may not be removed or altered from any source distribution."""),
    ("CC0-1.0", "cc0 1", "Licensed under CC0 1.0."),
]
TEMPLATES += [
    (name, f"spdx {must}", f"SPDX-License-Identifier: {name}")
    for name, must in [("GPL-2.0", "gpl 2"), ("GPL-3.0", "gpl 3"), ("LGPL-2.1", "lgpl 2 1"), ("LGPL-3.0", "lgpl 3"), ("AGPL-3.0", "agpl 3"), ("BSD-2-Clause", "bsd 2"), ("BSD-3-Clause", "bsd 3"), ("ISC", "isc"), ("MPL-2.0", "mpl 2"), ("Unlicense", "unlicense"), ("BSL-1.0", "bsl 1"), ("EPL-2.0", "epl 2"), ("Zlib", "zlib"), ("CC0-1.0", "cc0 1")]
]
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _v in ("4.0", "3.0", "2.5", "2.0", "1.0", ""):
    _kind = {"4.0": " 4.0 International", "": ""}.get(_v, f" {_v}" + " Unported" * (_v == "3.0"))
    # a version's zero may be left out of a long notice
    _no = _v.removesuffix(".0").replace(".", " ")
    for _s, _long in _CC.items():
        _name = f"CC-{_s}-{_v}".rstrip("-")
        TEMPLATES += [
            (_name, f"cc {_s} {_no}", f"Licensed under CC {_s} {_v}"),
            (_name, f"license cc {_s} {_no}", f"License: CC {_s} {_v}"),
            (_name, f"spdx cc {_s} {_no}", f"SPDX-License-Identifier: CC-{_s}-{_v}"),
            (_name, f"commons {_long} {_no}", f"Licensed under a Creative Commons {_long}{_kind} License."),
            (_name, f"commons {_long} {_no}", f"This work is licensed under a Creative Commons {_long}{_kind} License."),
        ]


def longest_rise(x: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence of x."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, v in enumerate(x):
        k = bisect_left(tops, v)
        before.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience alignment: pairs (i, j), both rising, with a[i] == b[j]."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 >= i1 or j0 >= j1:
            continue
        once_a, once_b = _once(a, i0, i1), _once(b, j0, j1)
        pairs = sorted((i, once_b[w]) for w, i in once_a.items() if w in once_b)
        anchors = [pairs[k] for k in longest_rise([j for _, j in pairs])]
        out += anchors
        if anchors:
            edges = [(i0 - 1, j0 - 1), *anchors, (i1, j1)]
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


def _once(x: list[int], lo: int, hi: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for i in range(lo, hi):
        seen[x[i]] = -1 if x[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


@dataclass
class Templates:
    names: list[str]
    words: list[list[int]]  # places in vocab
    must: list[set[int]]
    vocab: np.ndarray  # sorted hashes
    count: np.ndarray  # [vocab, templates]
    needed: np.ndarray  # [vocab, templates], 1 for the words of must


def compiled(templates: list[tuple[str, str, str]]) -> Templates:
    w = K.words(pa.array([t for _, _, t in templates]))
    m = K.words(pa.array([t for _, t, _ in templates]))
    vocab = np.unique(w.hash)
    words = [np.searchsorted(vocab, w.hash[a:b]).tolist() for a, b in zip(w.first, w.first[1:])]
    must = [set(np.searchsorted(vocab, m.hash[a:b]).tolist()) for a, b in zip(m.first, m.first[1:])]
    # in floats products are fast, and exact at this size
    count, needed = np.zeros((2, len(vocab), len(words)), dtype=np.float32)
    for t, x in enumerate(words):
        np.add.at(count[:, t], x, 1)
        needed[list(must[t]), t] = 1
    return Templates([n for n, _, _ in templates], words, must, vocab, count, needed)


def _matches(pos: np.ndarray, ids: np.ndarray, template: list[int], must: set[int], coverage: float) -> Iterator[tuple[int, int, int]]:
    """(first word, last word, words aligned) of a template in one text, given
    the places and ids of its words that the template has."""
    need = int(np.ceil(coverage * len(template)))
    reach = int(STRETCH * len(template)) + SLACK
    end = np.searchsorted(pos, pos + reach)

    def aligned(at: int) -> list[tuple[int, int]]:
        """(place among the hits, place in the template), if it is a match."""
        p, part = pos[at : end[at]].tolist(), ids[at : end[at]].tolist()
        pairs = align(part, template)
        # words far off on either side belong to something else
        while len(pairs) > 1 and p[pairs[1][0]] - p[pairs[0][0]] > pairs[1][1] - pairs[0][1] + 2 * SLACK:
            pairs = pairs[1:]
        while len(pairs) > 1 and p[pairs[-1][0]] - p[pairs[-2][0]] > pairs[-1][1] - pairs[-2][1] + 2 * SLACK:
            pairs = pairs[:-1]
        if len(pairs) < need or not must <= {template[j] for _, j in pairs}:
            return []
        return [(at + i, j) for i, j in pairs]

    at = 0
    while at < len(pos):
        able = np.flatnonzero(end[at:] - np.arange(at, len(pos)) >= need)
        if not len(able):
            return
        at += int(able[0])
        pairs = aligned(at)
        # stray words before the notice can cost it some: later starts may do better
        last = pairs[0][0] + len(template) // 4 if pairs else at
        for k in range(at + 1, min(last + 1, len(pos))):
            if len(pairs) == len(template):
                break
            pairs = max(pairs, aligned(k), key=len)
        if pairs:
            yield int(pos[pairs[0][0]]), int(pos[pairs[-1][0]]), len(pairs)
            at = pairs[-1][0] + 1
        else:
            at += 1


def notices(texts: pa.Array, t: Templates, coverage: float = COVERAGE) -> Iterator[tuple]:
    """(row, license, first character, end, coverage, words aligned)."""
    for lo, hi in K.slices(texts):
        w = K.words(texts.slice(lo, hi - lo))
        if not len(w.hash):
            continue
        i = np.minimum(np.searchsorted(t.vocab, w.hash), len(t.vocab) - 1)
        hit = np.flatnonzero(t.vocab[i] == w.hash)
        doc, ids = np.searchsorted(w.first, hit, side="right") - 1, i[hit]
        have = np.zeros((w.docs, len(t.vocab)), dtype=np.float32)
        have[doc, ids] = 1
        most = have @ t.count
        enough = (most >= np.ceil(coverage * t.count.sum(0, dtype=np.float64))) & (have @ t.needed == t.needed.sum(0))
        if not enough.any():
            continue
        chars = K.char_starts(w.data)
        for d in np.flatnonzero(enough.any(1)):
            a, b = np.searchsorted(doc, (d, d + 1))
            at, word = hit[a:b], ids[a:b]
            found = []
            for k in np.flatnonzero(enough[d]):
                own = t.count[word, k] > 0
                found += [(-n, -n / len(t.words[k]), s, e, int(k)) for s, e, n in _matches(at[own], word[own], t.words[k], t.must[k], coverage)]
            kept: list[tuple[int, int]] = []
            rows = []
            for n, c, s, e, k in sorted(found):
                if all(e < x or s > y for x, y in kept):
                    kept.append((s, e))
                    rows.append((s, e, k, -c, -n))
            o = chars[w.offsets[d]]
            for s, e, k, c, n in sorted(rows):
                yield lo + int(d), t.names[k], int(chars[w.start[s]] - o), int(chars[w.end[e]] - o), c, n


def licenses(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, start_char, end_char, coverage, n_words: each notice
    that covers at least ``coverage`` of a template's words, within a stretch
    of one and a half times its length.

    Of overlapping notices the one with the most aligned words stays, in a tie
    the one of more coverage, then the earlier, then the template first in the
    list. Every repetition in a text counts. Null and empty texts have none,
    repeated rows have theirs each, null ids are passed on, other columns are
    ignored.
    """
    t = compiled(templates or TEMPLATES)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(notices(text_column(b), t, coverage))
            c = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c[0], pa.int64())), *(pa.array(x, k) for x, k in zip(c[1:], kinds))], names=["doc_id", "license", "start_char", "end_char", "coverage", "n_words"])

    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    return mapped(d, f, "doc_id long, license string, start_char long, end_char long, coverage double, n_words long")
