"""License scans by conditional compression.

A block of text (sentences that speak of licensing, and the words around them that templates share) is compressed alone
and with each template as a raw zstandard dictionary. The templates that shorten it most, and all that come within
MARGIN of the best, are held against it word by word; the one with the most words in common, less those missing and
added, explains it. Its first to its last common word is the finding; it is confirmed if the template shortens it by LEAST_REDUCTION,
at most MOST_MISSING of the template's words are missing and MOST_ADDED of the finding's are added, and none of these
names another license. What is left of a block before and behind a confirmed finding is looked at again. An SPDX tag is an exact
line and a finding of its own.

Templates are the titles and notices below, the standard texts and headers below, and whole license texts in a folder (a parameter), where it has them;
a broadcast takes them to the tasks.

Defined cases: null and empty texts have no findings; repeated blocks of a text are separate
findings; equal templates go to the license named first in the alphabet; a long text is
scanned whole, in linear time; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import columns as C

# Titles by which notices name a license.
TITLES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0"],
    "ISC": ["ISC License"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
}
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{mark2} either version {version} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""
# Standard texts and headers as the licenses give them.
TEXTS = {
    "MIT": [_MIT, "MIT License " + _MIT],
    "BSD-2-Clause": [_BSD_HEAD + " " + _BSD_TAIL, _BSD_HEAD],
    "BSD-3-Clause": [_BSD_HEAD + " " + _BSD_THIRD + " " + _BSD_TAIL, _BSD_HEAD + " " + _BSD_THIRD],
    "ISC": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""],
    "Apache-2.0": ["""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""],
    "GPL-3.0": [_GNU.format(what="program", mark=":", mark2=",", name="General Public License", version="3")],
    "GPL-2.0": [_GNU.format(what="program", mark=";", mark2=";", name="General Public License", version="2")],
    "LGPL-3.0": [_GNU.format(what="library", mark=":", mark2=",", name="Lesser General Public License", version="3")],
    "LGPL-2.1": [_GNU.format(what="library", mark=";", mark2=";", name="Lesser General Public License", version="2.1")],
    "AGPL-3.0": [_GNU.format(what="program", mark=":", mark2=",", name="Affero General Public License", version="3")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "All-Rights-Reserved": ["All rights reserved.", "Copyright. All rights reserved."],
}
# Names of whole texts in a folder of licenses.
FILES = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic-1.0": "Artistic"}
FOLDER = "/usr/share/common-licenses"
#: Words of which one that is added makes another license.
TELLING = {"affero", "lesser", "library", "noncommercial", "sharealike", "noderivatives", "nc", "sa", "nd", "by-nc", "by-sa", "by-nd", "by-nc-sa"}
MARGIN, LEAST_REDUCTION, MOST_MISSING, MOST_ADDED = 0.15, 0.3, 0.35, 0.2
#: Words that no template has, at most, between parts of a block; and words in a row that show a template.
GAP, RUN = 12, 4
PIECE = 8192

HINTS = ("licens", "copyright", "all rights reserved", "public domain", "redistribut", "creative commons", "permission is hereby", "permission to use", "spdx")
FINDINGS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("block", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("license", T.StringType()),
        T.StructField("reduction", T.DoubleType()),
        T.StructField("runner_up", T.StringType()),
        T.StructField("missing", T.StringType()),
        T.StructField("added", T.StringType()),
        T.StructField("confirmed", T.BooleanType()),
    ]
)
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+\-]{1,64}(?: (?:AND|OR|WITH) [A-Za-z0-9.+\-]{1,64}){0,8})")
_HINT = re.compile("|".join(HINTS))
_STOP = re.compile(r"\n|[.!?](?=\s|$)")
_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*|\d+(?:\.\d+)*")


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)  # a few letters become two; places must stay


def templates(folder: str | None = FOLDER) -> tuple[tuple[str, str], ...]:
    """(license, text) of all templates; those of a folder that isn't there are left out."""
    found = [(k, f"Licensed under the {t}.") for k, titles in TITLES.items() for t in titles] + [(k, t) for k, texts in TEXTS.items() for t in texts]
    for k, name in FILES.items() if folder and os.path.isdir(folder) else ():
        path = os.path.join(folder, name)
        if os.path.exists(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                found.append((k, f.read()))
    return tuple(sorted(found))


class Scanner:
    """Templates with their words, dictionaries and the runs of words that they share with a block."""

    def __init__(self, given: tuple[tuple[str, str], ...]):
        import zstandard

        self.names = [k for k, _ in given]
        self.words = [_WORD.findall(lowered(t)) for _, t in given]
        self.alone = zstandard.ZstdCompressor(level=10)
        self.with_template = []
        for _, t in given:
            d = zstandard.ZstdCompressionDict(lowered(t).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=10)
            self.with_template.append(zstandard.ZstdCompressor(level=10, dict_data=d))
        self.runs = {tuple(w[i : i + RUN]) for w in self.words for i in range(len(w) - RUN + 1)}
        self.explained = lru_cache(maxsize=4096)(self._explained)

    def blocks(self, low: str) -> list[tuple[int, int]]:
        """Ranges of the sentences that hold a hint, with the neighbouring words that templates have in their order."""
        hints = [m.span() for m in _HINT.finditer(low)]
        if not hints:
            return []
        stops = [m.end() for m in _STOP.finditer(low)]
        found = [(m.group(), *m.span()) for m in _WORD.finditer(low)]
        words, starts, ends = [w for w, _, _ in found], [a for _, a, _ in found], [b for _, _, b in found]
        known = [False] * (len(words) + 1)
        for i in range(len(words) - RUN + 1):
            if tuple(words[i : i + RUN]) in self.runs:
                known[i : i + RUN] = [True] * RUN
        near = [i for i in range(len(words)) if known[i]]
        out: list[list[int]] = []
        for start, end in hints:
            if out and start < out[-1][1]:
                continue
            k = bisect.bisect_right(stops, start)
            a = stops[k - 1] if k else 0
            k = bisect.bisect_left(stops, end)
            b = stops[k] if k < len(stops) else len(low)
            first, last = bisect.bisect_left(starts, a), bisect.bisect_left(starts, b) - 1
            i = bisect.bisect_left(near, first)
            while i > 0 and first - near[i - 1] <= GAP and (not out or starts[near[i - 1]] >= out[-1][1]):
                i, first = i - 1, near[i - 1]
            i = bisect.bisect_right(near, last)
            while i < len(near) and near[i] - last <= GAP:
                last, i = near[i], i + 1
            a, b = min(a, starts[first]) if first < len(starts) else a, max(b, ends[last]) if last >= 0 else b
            while a < start and low[a].isspace():
                a += 1
            while b > end and low[b - 1].isspace():
                b -= 1
            if out and a <= out[-1][1] + 1 and not low[out[-1][1] : a].strip():
                out[-1][1] = max(b, out[-1][1])
            else:
                out.append([a, b])
        # What is longer than any license is looked at in pieces, so that the work stays linear.
        pieces = []
        for a, b in out:
            first, last = bisect.bisect_left(starts, a), bisect.bisect_left(starts, b)
            for i in range(first, max(last, first + 1), PIECE):
                pieces.append((a if i == first else starts[i], b if i + PIECE >= last else ends[i + PIECE - 1]))
        return pieces

    def reduction(self, k: int, raw: bytes) -> float:
        return 1 - len(self.with_template[k].compress(raw)) / len(self.alone.compress(raw))

    def _explained(self, block: str):
        """(template, runner-up's license, reduction, missing words, added words, first and last place of what it explains, confirmed)."""
        found = [(m.group(), *m.span()) for m in _WORD.finditer(block)]
        words = [w for w, _, _ in found]
        raw = block.encode()
        ranked = sorted(((self.reduction(k, raw), k) for k in range(len(self.names))), key=lambda x: (-x[0], x[1]))
        best = None
        for r, k in ranked:
            if r < ranked[0][0] - MARGIN:
                break
            same, missing, added, a, b = difference(self.words[k], words)
            fits = self._fits(k, same, missing, added)
            rank = (not fits, len(missing) + len(added) - same if fits else -r, k)
            if best is None or rank < best[0]:
                best = (rank, k, missing, added, a, b, fits)
        _, k, missing, added, a, b, fits = best
        first, last = (found[a][1], found[b - 1][2]) if fits else (0, len(block))
        r = self.reduction(k, block[first:last].encode())
        other = next((self.names[n] for _, n in ranked if self.names[n] != self.names[k]), None)
        return self.names[k], other, r, " ".join(missing), " ".join(added), first, last, fits and r >= LEAST_REDUCTION

    def _fits(self, k: int, same: int, missing: list, added: list) -> bool:
        return same > 1 and len(missing) <= MOST_MISSING * len(self.words[k]) and len(added) <= MOST_ADDED * (same + len(added)) and not TELLING.intersection(added) and not TELLING.intersection(missing)

    def findings(self, text: str):
        """(start, length, license, reduction, runner-up, missing, added, confirmed) in order."""
        low = lowered(text)
        tags = [(m.start(), m.end() - m.start(), m.group(1), 1.0, None, "", "", True) for m in _SPDX.finditer(text)]
        for start, length, *_ in reversed(tags):
            low = low[:start] + "\n" * length + low[start + length :]
        out, todo = tags, self.blocks(low)
        while todo:
            a, b = todo.pop()
            name, other, r, missing, added, first, last, confirmed = self.explained(low[a:b])
            out.append((a + first, last - first, name, float(r), other, missing, added, bool(confirmed)))
            if confirmed:
                todo.extend((x, y) for x, y in ((a, a + first), (a + last, b)) if _HINT.search(low, x, y))
        return sorted(out, key=lambda x: x[:2])


def difference(own: list[str], words: list[str]) -> tuple[int, list[str], list[str], int, int]:
    """Words in common, those of `own` that are missing, those that are added between the first and last common one, and where these stand (from, to)."""
    blocks = _matching(own, words)
    if not blocks:
        return 0, list(own), [], 0, len(words)
    missing, added, i, j = [], [], 0, blocks[0][1]
    for a, b, n in blocks:
        missing += own[i:a]
        added += words[j:b]
        i, j = a + n, b + n
    return sum(n for _, _, n in blocks), missing + own[i:], added, blocks[0][1], j


def _matching(own, words):
    """(place in own, place in words, length) of the runs of a longest common subsequence, in order.

    Of those that are as long it is the one that ends first and then lies closest to its end. Rows are kept as the bits of
    one number each (a bit is 0 where the length grows), so that texts of any size are compared in the same way.
    """
    full, at = (1 << len(own)) - 1, {}
    for i, w in enumerate(own):
        at[w] = at.get(w, 0) | 1 << i
    rows = [full]
    for w in words:
        v, hit = rows[-1], rows[-1] & at.get(w, 0)
        rows.append(((v + hit) | (v - hit)) & full)
    least = rows[-1].bit_count()
    i, j = len(own), next(j for j, v in enumerate(rows) if v.bit_count() == least)
    out: list[tuple[int, int, int]] = []
    while i and j:
        if own[i - 1] == words[j - 1]:
            i, j = i - 1, j - 1
            if out and out[-1][:2] == (i + 1, j + 1):
                out[-1] = (i, j, out[-1][2] + 1)
            else:
                out.append((i, j, 1))
        elif rows[j] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


_scanners: dict = {}


def scanner(given: tuple[tuple[str, str], ...]) -> Scanner:
    """One for each set of templates and Python worker."""
    if given not in _scanners:
        _scanners[given] = Scanner(given)
    return _scanners[given]


def scan(docs: DataFrame, folder: str | None = FOLDER) -> DataFrame:
    """A row (FINDINGS) for each block of each text. `folder` may have whole license texts; the driver reads them."""
    spark = docs.sparkSession
    C.session_limits(spark)
    shared = spark.sparkContext.broadcast(templates(folder))

    def run(batches):
        s = scanner(shared.value)
        kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
        for b in C.slices(batches):
            rows = [(doc, k, *found) for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for k, found in enumerate(s.findings(text))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.simpleString()]) for f, c in zip(FINDINGS, zip(*rows))], names=FINDINGS.names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.filter(F.lower("text").rlike("|".join(HINTS))).mapInArrow(run, FINDINGS)
