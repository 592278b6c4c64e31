"""License scans by conditional compression.

Texts are read as words, so that line ends, comment marks and punctuation do not matter. Around each cue word, every template
that holds a cue of its kind is laid over the text with the two cues in one place, and the words that it covers (and as many more on
either side as may be added) are its window. A window is trimmed to the template's first and last matching words, and
compressed with zstandard, once plainly and once with the template as raw dictionary; the share of bytes saved is therefore that of the
notice and not of the text around it. A match is confirmed by its wording: the words that the window lacks and those that
it adds in between are listed, and it counts if these are few and neither a number nor a license's name is
among them, as these tell licenses apart. Confirmed matches are taken by the bytes they save, each one outside those
taken before, until none is left.

Notices repeat in many documents, so each distinct one is compressed once per Python worker and template and remembered.

Defined results: null and empty texts have no notices. Rows that repeat an id or a text are reported as often as they come; null
ids are kept. An empty table gives no rows. Extra columns are ignored. Texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

LEAST_SAVED = 0.25  # share of the plain compressed size that a template must save
MOST_DIFFERENT = 0.2  # words lacking or added, as a share of the template's words
KNOWN = 50_000

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str, version: str) -> str:
    return (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        f"{name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )


# Notices of public licenses, and the whole texts of the short ones, as their authors word them.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.", _gnu("General Public License", "3")),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0.", _gnu("General Public License", "2")),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", _gnu("Lesser General Public License", "3")),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", _gnu("Affero General Public License", "3")),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        _BSD + _BSD_THIRD + _BSD_END,
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", _BSD + _BSD_END),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.",),
    "LicenseRef-all-rights-reserved": ("All rights reserved.",),
}

CUES = ("licens", "licenc", "rights reserved", "copyright", "permission is", "redistribution", "public domain", "creative commons")
_CUE = re.compile("(licen[sc])|(reserved$)|(copyright)|(permission$)|(redistribution)|(domain$)|(commons$)")  # the kinds of cue words
_WORD = re.compile(r"\w(?:[\w.-]*\w)?")
_MARKS = re.compile(r"[^\w\s]*")
NAMES = frozenset(
    "mit apache gnu lesser library affero bsd mozilla isc cc creative commons attribution sharealike noncommercial noderivatives noderivs by sa nc nd".split()
)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def cues(found: list[str]) -> list[tuple[int, int]]:
    """(place, kind) of the cue words."""
    return [(i, m.lastindex) for i, w in enumerate(found) if (m := _CUE.search(w))]


@dataclass(frozen=True)
class Template:
    name: str
    text: str
    words: tuple[str, ...]
    distinct: frozenset[str]
    cues: tuple[tuple[int, int], ...]
    spare: int  # words that may be lacking or added


@lru_cache(maxsize=1)
def templates() -> list[Template]:
    each = [(name, t, tuple(words(t))) for name, texts in TEMPLATES.items() for t in texts]
    return [Template(name, t, w, frozenset(w), tuple(cues(w)), int(MOST_DIFFERENT * len(w))) for name, t, w in each]


@lru_cache(maxsize=1)
def _packers() -> tuple[zstandard.ZstdCompressor, dict[str, zstandard.ZstdCompressor]]:
    of = lambda t: zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19), {t.text: zstandard.ZstdCompressor(level=19, dict_data=of(t.text)) for t in templates()}


@lru_cache(maxsize=KNOWN)
def savings(notice: str, template: str) -> tuple[int, float]:
    """Bytes and share of the notice's compressed size that the template saves."""
    plain, each = _packers()
    raw = notice.encode("utf-8", "replace")
    size = len(plain.compress(raw))
    saved = size - len(each[template].compress(raw))
    return saved, saved / size


def wording(a: tuple[str, ...], b: list[str]) -> tuple[int, int, list[str], list[str]]:
    """First and last place in ``b`` that match the template ``a``, words that ``b`` lacks, and words that it adds in between."""
    if list(a) == b:
        return 0, len(b), [], []
    same = [m for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return 0, 0, list(a), []
    matched = {i for m in same for i in range(m.a, m.a + m.size)}
    inside = {i for m in same for i in range(m.b, m.b + m.size)}
    start, stop = same[0].b, same[-1].b + same[-1].size
    return start, stop, [w for i, w in enumerate(a) if i not in matched], [b[i] for i in range(start, stop) if i not in inside]


def _tells(word: str) -> bool:
    return any(c.isdigit() for c in word) or not NAMES.isdisjoint(word.split("-"))


def notices(text: str) -> list[tuple[int, int, str, float, list[str], list[str]]]:
    """(start, length, license, share saved, lacking, added) of every confirmed notice, in the order of the text."""
    low = text.lower()
    if not any(cue.split()[0] in low for cue in CUES):
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    found = [text[a:b].lower() for a, b in spans]
    at = cues(found)
    confirmed = []
    for order, t in enumerate(templates()):
        n, seen = len(t.words), set()
        for begin in sorted({c - k for c, kind in at for k, own in t.cues if kind == own}):
            exact = begin >= 0 and tuple(found[begin : begin + n]) == t.words
            low_end, high_end = (begin, begin + n) if exact else (max(0, begin - t.spare), begin + n + t.spare)
            window = found[low_end:high_end]
            if len(t.distinct.difference(window)) > t.spare:
                continue
            start, stop, lacking, added = wording(t.words, window)
            start, stop = start + low_end, stop + low_end
            if len(lacking) + len(added) > t.spare or any(map(_tells, (*lacking, *added))) or (start, stop) in seen:
                continue
            seen.add((start, stop))
            first, last = spans[start][0], _MARKS.match(text, spans[stop - 1][1]).end()
            saved, share = savings(text[first:last], t.text)
            if share >= LEAST_SAVED:
                confirmed.append((-saved, len(lacking) + len(added), order, start, stop, (first, last - first, t.name, share, lacking, added)))
    taken: list[tuple] = []
    for *_, start, stop, row in sorted(confirmed):
        if all(stop <= a or start >= b for a, b, _ in taken):
            taken.append((start, stop, row))
    return [row for _, _, row in sorted(taken)]


def scan(docs: DataFrame) -> DataFrame:
    """One row per confirmed notice: doc_id, start, length, license, saved, lacking, added, exact."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                for start, length, name, saved, lacking, added in notices(text.as_py()):
                    out.append((doc_id.as_py(), start, length, name, saved, lacking, added, not lacking and not added))
            columns = list(zip(*out)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = "doc_id bigint, start bigint, length bigint, license string, saved double, lacking array<string>, added array<string>, exact boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_()]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).mapInArrow(task, schema)
