"""Licence notices in texts, by patience alignment with templates.

A text is looked at around the occurrences of a template's key words, the rarest
among all templates. They stand at so many of its places that a notice with enough
coverage cannot do without ``need`` of them; where a text has fewer, none is there.
There the words of text and template are aligned: words that both have exactly once
are anchors, the longest increasing run of anchors stays, and the gaps between them
are aligned in the same way, after equal words at their ends have been paired. The
share of the template's words that are paired is the coverage. What identifies a
short notice has to be there without a word in between. All offsets are code points
of the whole text, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from triflux.llm.licence_texts import FULL

COVERAGE = 0.8
#: The share of a template's words that keys stand for, above what coverage lets a notice miss.
KEYS = 0.2
#: Words around a template's place in a text that are aligned too, as a share of its words.
SLACK = 0.25
WORD = re.compile(r"[^\W_]+")

_BSD = """
Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the
above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in
binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """ 3. Neither the name of the copyright holder nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written
permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
_GNU = """
This program is free software: you can redistribute it and/or modify it under the terms of the {name}
as published by the Free Software Foundation, either version {version} of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name}
along with this program. If not, see <https://www.gnu.org/licenses/>."""
_GNU_NAMES = {
    "gpl": "GNU General Public License",
    "lgpl": "GNU Lesser General Public License",
    "agpl": "GNU Affero General Public License",
}
_GNU_VERSIONS = [("gpl", "2"), ("gpl", "3"), ("lgpl", "2.1"), ("lgpl", "3"), ("agpl", "3")]
_CC = {
    "by-sa": "Attribution-ShareAlike",
    "by-nd": "Attribution-NoDerivatives",
    "by-nc": "Attribution-NonCommercial",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
    "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}

# Notices as they are published. Of the lines the first four are also those that
# the generated test tables have.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License."
    ),
    "mit": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache-2.0": """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "gpl-3.0": """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should
have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
    "isc": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear
in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "bsd-2-clause": _BSD + _BSD_END,
    "bsd-3-clause": _BSD + _BSD_NAMES + _BSD_END,
    "unlicense": """
This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions
that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public
at large and to the detriment of our heirs and successors. We intend this dedication to be an overt
act of relinquishment in perpetuity of all present and future rights to this software under copyright
law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to
<https://unlicense.org>""",
    "mpl-2.0": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "cc0-1.0": """
To the extent possible under law, the author has waived all copyright and related or neighboring
rights to this work. This work is published under CC0 1.0 Universal.""",
    "bsd-line": "Released under the BSD License.",
    "cc-by-4.0-short-line": "Licensed under CC BY 4.0.",
}
#: Phrases that identify a notice: all have to be in a text without a word in between.
REQUIRED = {
    "apache-2.0-line": ("apache license version 2 0",),
    "mit-line": ("mit license",),
    "bsd-line": ("the bsd license",),
    "gpl-3.0-line": ("gnu general public license", "version 3"),
    "cc-by-nc-4.0-line": ("cc by nc 4 0",),
    "cc-by-4.0-line": ("creative commons attribution 4 0",),
    "cc-by-4.0-short-line": ("cc by 4 0",),
    "apache-2.0": ("apache license version 2 0",),
    "mpl-2.0": ("mozilla public license v 2 0",),
    "cc0-1.0": ("cc0 1 0",),
}
for _kind, _version in _GNU_VERSIONS:
    _name, _key = _GNU_NAMES[_kind], f"{_kind}-{_version if '.' in _version else _version + '.0'}"
    TEMPLATES.setdefault(_key, _GNU.format(name=_name, version=_version))
    TEMPLATES.setdefault(
        f"{_key}-line", f"This work is licensed under the {_name}, version {_version}."
    )
    _phrases = (_name.lower(), f"version {_version.replace('.', ' ')}")
    REQUIRED |= {_key: _phrases, f"{_key}-line": _phrases}
for _kind, _name in _CC.items():
    TEMPLATES.setdefault(f"cc-{_kind}-4.0-line", f"Licensed under CC {_kind.upper()} 4.0.")
    REQUIRED[f"cc-{_kind}-4.0-line"] = (f"cc {_kind.replace('-', ' ')} 4 0",)
    TEMPLATES[f"cc-{_kind}-4.0-long-line"] = (
        f"This work is licensed under the Creative Commons {_name} 4.0 International License."
    )
    REQUIRED[f"cc-{_kind}-4.0-long-line"] = (
        f"creative commons {_name.replace('-', ' ').lower()} 4 0",
    )
TEMPLATES |= FULL


class Notice(NamedTuple):
    start: int
    end: int
    licence: str
    matched: int
    coverage: float


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence of distinct values."""
    ends: list[int] = []
    tops: list[int] = []
    before = [-1] * len(values)
    for i, value in enumerate(values):
        k = bisect_left(ends, value)
        before[i] = tops[k - 1] if k else -1
        ends[k : k + 1] = [value]
        tops[k : k + 1] = [i]
    out, i = [], tops[-1] if tops else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions, increasing in both, of words that the alignment matches."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        own, other = Counter(text[a:b]), Counter(template[c:d])
        places = {w: c + i for i, w in enumerate(template[c:d]) if other[w] == 1}
        unique = [i for i in range(a, b) if own[text[i]] == 1 and text[i] in places]
        kept = [unique[k] for k in increasing([places[text[i]] for i in unique])]
        if not kept:
            continue
        last_a, last_c = a, c
        for i in kept:
            j = places[text[i]]
            pairs.append((i, j))
            gaps.append((last_a, i, last_c, j))
            last_a, last_c = i + 1, j + 1
        gaps.append((last_a, b, last_c, d))
    return sorted(pairs)


class Template(NamedTuple):
    """The words, what to look for, how often that is in every notice, and runs of places to pair."""

    words: list[str]
    keys: dict[str, list[int]]
    need: int
    required: list[list[range]]


class Matcher:
    """Finds the notices of a text with at least ``coverage``."""

    def __init__(
        self,
        templates: dict[str, str],
        coverage: float = COVERAGE,
        required: dict[str, tuple[str, ...]] = REQUIRED,
    ) -> None:
        self._coverage = coverage
        split = {k: WORD.findall(x.lower()) for k, x in templates.items()}
        spread = Counter(w for words in split.values() for w in set(words))
        self._templates: dict[str, Template] = {}
        self._keys: dict[str, list[str]] = {}
        for licence, words in split.items():
            phrases = [x.split() for x in required.get(licence, ())]
            runs = [
                [range(i, i + len(p)) for i in range(len(words)) if words[i : i + len(p)] == p]
                for p in phrases
            ]
            count = Counter(words)
            # Words of few templates first, long ones before short ones.
            ranked = sorted(count, key=lambda w: (spread[w], -len(w), w))
            if phrases:
                # Any word of a phrase is in every notice.
                keys, need = [min(phrases[0], key=lambda w: (spread[w], -len(w), w))], 1
            else:
                missed = len(words) - ceil(coverage * len(words))
                keys, n = [], 0
                while n < min(len(words), missed + max(1, int(KEYS * len(words)))):
                    keys.append(ranked[len(keys)])
                    n += count[keys[-1]]
                need = n - missed
            places = {k: [i for i, w in enumerate(words) if w == k] for k in keys}
            self._templates[licence] = Template(words, places, need, runs)
            for key in keys:
                self._keys.setdefault(key, []).append(licence)

    def _places(self, hits: list[int], words: list[str], template: Template) -> Iterator[int]:
        """Where the template may begin, to steps of a quarter of the slack before."""
        n = len(template.words)
        slack = int(SLACK * n) + 1
        step = max(1, slack // 4)
        seen: set[int] = set()
        for at in hits:
            for place in template.keys[words[at]]:
                first = (at - place) // step * step
                if first not in seen:
                    seen.add(first)
                    low, high = first - slack, first + n + slack + step
                    if bisect_left(hits, high) - bisect_left(hits, low) >= template.need:
                        yield first

    def _identified(self, pairs: list[tuple[int, int]], template: Template) -> bool:
        at = {c: a for a, c in pairs}
        return all(
            any(all(at.get(c, -1) == at.get(run[0], -2) + c - run[0] for c in run) for run in runs)
            for runs in template.required
        )

    def find(self, text: str | None) -> list[Notice]:
        """Notices by start; of those that overlap the one with more matched words stays."""
        if not text:
            return []
        words = [w.lower() for w in WORD.findall(text)]
        hits: dict[str, list[int]] = {}
        for at, word in enumerate(words):
            if word in self._keys:
                for licence in self._keys[word]:
                    hits.setdefault(licence, []).append(at)
        found: set[Notice] = set()
        tokens: list[tuple[int, int]] = []
        for licence, own in hits.items():
            template = self._templates[licence]
            if len(own) < template.need:
                continue
            n = len(template.words)
            slack = int(SLACK * n) + 1
            step = max(1, slack // 4)
            for first in self._places(own, words, template):
                low, high = max(0, first - slack), max(0, first + n + slack + step)
                pairs = align(words[low:high], template.words)
                if len(pairs) >= self._coverage * n and self._identified(pairs, template):
                    tokens = tokens or [m.span() for m in WORD.finditer(text)]
                    begin, end = tokens[low + pairs[0][0]][0], tokens[low + pairs[-1][0]][1]
                    found.add(Notice(begin, end, licence, len(pairs), len(pairs) / n))
        kept: list[Notice] = []
        taken: list[tuple[int, int]] = []
        for notice in sorted(found, key=lambda x: (-x.matched, -x.coverage, x)):
            # Kept notices do not overlap, so the neighbours by start are enough.
            k = bisect_left(taken, (notice.start, notice.end))
            before = k > 0 and taken[k - 1][1] > notice.start
            after = k < len(taken) and taken[k][0] < notice.end
            if not before and not after:
                taken.insert(k, (notice.start, notice.end))
                kept.append(notice)
        return sorted(kept)


FOUND = "doc_id long, licence string, start long, end long, matched long, coverage double"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each notice in ``docs (doc_id, text)``; columns are those of ``FOUND``.

    Null and empty texts, and texts without a notice, have no row. Rows are
    independent: a repeated row has its notices again. Other columns are ignored.
    """
    known = TEMPLATES if templates is None else templates
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(known)
        for batch in batches:
            rows = [
                (doc_id, x.licence, x.start, x.end, x.matched, x.coverage)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                for x in matcher.find(text.as_py())
            ]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names
            )

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)
