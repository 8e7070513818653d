"""License texts and notices in whole documents.

Templates are cut into word k-grams; winnowing keeps the least hash of each window of them as the
fingerprints of an inverted index, whose size is bounded by the templates. A document's k-grams are
looked up in it. Hits of a template that lie near one diagonal make a candidate, and a banded
alignment of the template with the document around that diagonal gives the words that match, their
share of the template (coverage), and the span in the document.

Defined results: words are runs of ASCII letters and digits, and dots between digits, in lower
case; a null text has no match; each match of a document is a row, and overlapping matches of
different templates are all given, but a match whose span lies within that of a better covered one
of the same template is not; equal hits go to the first in order; repeated rows each give their
matches; columns of the input stay, except those named as the output; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K, WINDOW, BAND = 3, 3, 8
#: Share of a template's words that has to match.
LEAST_COVERAGE = 0.7
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")

# Wordings of common license notices and texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause-names": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
        "license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to "
        "permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, "
        "including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all "
        "derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source "
        "language processor."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public "
        "domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
        "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
}

MATCH = [
    ("license", T.StringType(), pa.string()),
    ("start", T.IntegerType(), pa.int32()),
    ("end", T.IntegerType(), pa.int32()),
    ("matched_words", T.IntegerType(), pa.int32()),
    ("coverage", T.DoubleType(), pa.float64()),
]


def folded(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def gram_hash(words: list[str]) -> int:
    return zlib.crc32(" ".join(words).encode())


def winnowed(hashes: list[int]) -> list[int]:
    """Places of the rightmost least hash of each window."""
    out = []
    for lo in range(max(1, len(hashes) - WINDOW + 1)):
        part = hashes[lo : lo + WINDOW]
        if part:
            at = lo + max(i for i, h in enumerate(part) if h == min(part))
            if not out or out[-1] != at:
                out.append(at)
    return out


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = list(templates)
        self.words = [WORD.findall(folded(t)) for t in templates.values()]
        self.known = {w for ws in self.words for w in ws}
        self.grams: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for k, ws in enumerate(self.words):
            size = min(K, len(ws))
            grams = [tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)]
            for i in winnowed([gram_hash(list(g)) for g in grams]):
                self.grams[grams[i]].append((k, i))
        # a document without the rarest word of some fingerprint can hold none: a cheap first test
        longest = {max(g, key=len) for g in self.grams}
        self.hint = re.compile("|".join(sorted(map(re.escape, longest))))

    def matches(self, text: str | None) -> list[tuple[str, int, int, int, float]]:
        if not text or not self.hint.search(low := folded(text)):
            return []
        found = list(WORD.finditer(low))
        words = [m.group() for m in found]
        hits: dict[int, list[int]] = defaultdict(list)
        known = self.known
        run = [w in known for w in words]
        for i in range(len(words) - K + 1):
            if run[i] and run[i + 1] and run[i + 2]:
                for k, j in self.grams.get(tuple(words[i : i + K]), ()):
                    hits[k].append(i - j)
        out = []
        for k, starts in sorted(hits.items()):
            best: list[tuple[int, int, int]] = []
            for d in diagonals(sorted(starts)):
                n = len(self.words[k])
                lo, hi = max(0, d - BAND), min(len(words), d + n + BAND)
                got = aligned(self.words[k], words[lo:hi], d - lo)
                if got and got[0] >= LEAST_COVERAGE * n:
                    best.append((got[0], lo + got[1], lo + got[2]))
            best.sort(key=lambda x: (-x[0], x[1]))
            taken: list[tuple[int, int, int]] = []
            for b in best:
                if not any(b[1] < t[2] and t[1] < b[2] for t in taken):
                    taken.append(b)
            out += [(self.names[k], found[a].start(), found[e - 1].end(), m, m / len(self.words[k])) for m, a, e in taken]
        return sorted(out, key=lambda x: (x[1], -x[3], x[0]))


def diagonals(starts: list[int]) -> Iterator[int]:
    """One for each run of hits within the band."""
    first = None
    for s in starts:
        if first is None or s - first > BAND:
            first = s
            yield s


def aligned(template: list[str], part: list[str], diagonal: int) -> tuple[int, int, int] | None:
    """(words matched, begin, end in part) of the best common subsequence within the band."""
    n, m = len(template), len(part)
    none = (0, 0, 0)  # matched, begin, minus end: later begin and earlier end win ties
    row, at = [none], 0  # row[x] is the best within the first at + x words
    best = none
    for i in range(n):
        lo, hi = (min(m, max(0, i + diagonal + x)) for x in (-BAND, BAND + 1))
        row = row[lo - at :] + [none] * (hi - at + 1 - max(len(row), lo - at))
        new = row[:1]
        for j in range(lo, hi):
            x = max(row[j + 1 - lo], new[-1])
            if template[i] == part[j]:
                count, begin, _ = row[j - lo]
                x = max(x, (count + 1, begin if count else j, -(j + 1)))
            new.append(x)
            best = max(best, x)
        row, at = new, lo
    return (best[0], best[1], -best[2]) if best[0] else None


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row for each match: docs without its text, with license, start, end, matched_words and
    coverage. Each row is scanned where it is read; nothing is shuffled."""
    new = [x[0] for x in MATCH]
    kept = [c for c in docs.columns if c not in (*new, text)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t, False) for n, t, _ in MATCH])
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for b in batches:
            at, rows = [], []
            for i, x in enumerate(b.column(b.num_columns - 1)):
                for m in index.matches(x.as_py()):
                    at.append(i)
                    rows.append(m)
            columns = list(zip(*rows)) or [()] * len(MATCH)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]), *(pa.array(v, t) for v, (_, _, t) in zip(columns, MATCH))], names=[*kept, *new]
            )

    return source.mapInArrow(run, schema)
