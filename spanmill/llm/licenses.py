"""License notices found by conditional compression.

A text with a cue word is cut into sentences and lines; neighbours that are
mostly made of the templates' words form candidate blocks around a cue. Each
block is compressed alone and with each template as a raw zstandard dictionary,
and templates are ranked by what they save. In this order each template is compared
with the block word by word; only those that hold too few of the block's words to
reach ``agree`` in any alignment are passed over. The one with the fewest differences
wins if it agrees with at least ``agree`` of its words and names the same license:
the words of the template that tell licenses apart (names, versions, clauses) have to
stand in the part that fits, and no other such word may stand there. Wordings that
agree but name another license are findings of the license ``unknown (nearest X)``.
What a winner and its repeats cover is cut out and the rest of the block is looked at
again, so that adjoining notices are all found.

Templates are a fixed list given with the call; each task holds their
dictionaries. Documents are independent, so there is no shuffle and no group.

Defined results: a null or empty text has no findings; texts of any length are
scanned whole; ties in reduction go to the template that is listed first, ties
in differences to the larger reduction; equal texts have equal findings; a null
``doc_id`` stays null; repeated rows are scanned one by one; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_MIT_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_ADVERTISING = (
    "All advertising materials mentioning features or use of this software must display the following acknowledgement: "
    "This product includes software developed by the copyright holder and its contributors. "
)
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version {} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)
#: Public license notices, (license, wording).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT_GRANT + _MIT_DISCLAIMER),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL.format(3)),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GPL.format(2)),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", _GPL.format(3).replace("General", "Lesser General")),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("LGPL-2.1", _GPL.format(2.1).replace("General", "Lesser General")),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("AGPL-3.0", _GPL.format(3).replace("General", "Affero General")),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("BSD-2-Clause", _BSD_GRANT),
    ("BSD-2-Clause", _BSD_GRANT + _DISCLAIMER),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_NAMES),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_NAMES + _DISCLAIMER),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-4-Clause", _BSD_GRANT + _BSD_ADVERTISING + _BSD_NAMES + _DISCLAIMER),
    ("BSD-4-Clause", "SPDX-License-Identifier: BSD-4-Clause"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0."),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
#: A text without any of these holds no notice.
CUES = ("licens", "licenc", "copyright", "spdx", "redistribut", "warrant", "hereby granted", "public domain", "creative commons", "public license")

# Words that tell licenses apart. Short ones and versions do so only beside a template that has one.
TELLING = frozenset("mit apache gnu general lesser affero gpl lgpl agpl bsd clause advertising mozilla mpl eclipse epl boost bsl creative commons attribution sharealike noncommercial noderivatives noderivs isc zlib unencumbered".split())
TELLING_SHORT = frozenset("cc by sa nc nd".split())
#: What makes another license of one whose name ends before it.
GOES_ON = frozenset(("0", "clear"))
VERSION = re.compile(r"[0-9]{1,2}(?:\.[0-9]+)*")

WORD = re.compile(r"[0-9a-z]+(?:\.[0-9]+)*")
UNIT = re.compile(r"[^\n.;]+(?:[.;](?!\s)[^\n.;]*)*[.;]?")
FEWEST = 3
#: Words of blocks whose winners a task remembers.
WORDS_KEPT = 1_000_000


class Scanner:
    """Compressors and words of the templates."""

    def __init__(self, templates=TEMPLATES, agree: float = 0.8):
        self.agree = agree
        self.names = [name for name, _ in templates]
        self.words = [WORD.findall(text.lower()) for _, text in templates]
        self.counts = [Counter(words) for words in self.words]
        self.telling = [self.told(words, words) for words in self.words]
        self.vocabulary = frozenset(w for words in self.words for w in words)
        plain = zstandard.ZstdCompressionParameters.from_level(19, window_log=17, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.alone = zstandard.ZstdCompressor(compression_params=plain)
        self.given = []
        for words in self.words:
            own = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given.append(zstandard.ZstdCompressor(dict_data=own, compression_params=plain))
        self.known: dict[tuple[str, ...], tuple | None] = {}
        self.held = 0
        # A block is searched piece by piece; a notice that starts in the last ``room`` words of a piece is left to the next.
        self.room = 2 * max(map(len, self.words), default=1)
        self.piece = 3 * self.room

    @staticmethod
    def told(words: list[str], own: list[str]) -> frozenset[str]:
        """Which of ``words`` tell licenses apart beside a template of the words ``own``."""
        short, version = "cc" in own, any(VERSION.fullmatch(w) for w in own)
        return frozenset(w for w in words if w in TELLING or short and w in TELLING_SHORT or version and VERSION.fullmatch(w))

    def candidates(self, words: list[str]) -> list[tuple[float, int]]:
        """(reduction, template), the largest reduction first, of the templates that could agree with a part of the block."""
        block = " ".join(words).encode()
        base, held = len(self.alone.compress(block)), Counter(words)
        out = []
        for k, (own, c) in enumerate(zip(self.counts, self.given, strict=True)):
            # No alignment matches more words than both sides have, and the part that fits is as long as what is matched.
            most, size = sum(min(n, held[w]) for w, n in own.items()), len(self.words[k])
            if 2 * most >= self.agree * (size + most):
                out.append(((base - len(c.compress(block))) / base, k))
        return sorted(out, key=lambda x: (-x[0], x[1]))

    def same_license(self, words: list[str], k: int, start: int, stop: int) -> bool:
        """Whether the part of ``words`` that the template fits tells the template's license and no other."""
        after = words[stop] if stop < len(words) else ""
        return self.told(words[start:stop], self.words[k]) == self.telling[k] and not (after in GOES_ON and self.words[k][-1] == words[stop - 1])

    def compare(self, words: list[str], k: int) -> tuple[float, list[str], int, int]:
        """(agreement, differences, start, stop): the template's wording against the part of the block that it fits."""
        own = self.words[k]
        same = [m for m in difflib.SequenceMatcher(None, own, words, autojunk=False).get_matching_blocks() if m.size]
        # Matches far apart belong to other text: take the run of matches that covers most of the template.
        if not same:
            return 0.0, [], 0, 0
        runs, run = [], [same[0]]
        for m in same[1:]:
            if m.b - run[-1].b - run[-1].size > max(4, len(own) // 4):
                runs.append(run)
                run = []
            run.append(m)
        runs.append(run)
        run = max(runs, key=lambda r: sum(m.size for m in r))
        matched, start, stop = sum(m.size for m in run), run[0].b, run[-1].b + run[-1].size
        gone, more, a, b = [], [], 0, start
        for m in run:
            gone += own[a : m.a]
            more += words[b : m.b]
            a, b = m.a + m.size, m.b + m.size
        gone += own[a:]
        return 2 * matched / (len(own) + stop - start), [f"-{w}" for w in gone] + [f"+{w}" for w in more], start, stop

    def winner(self, words: list[str]) -> tuple[str, int, int, float, list[str]] | None:
        """The notice of ``words`` that fits best: (license, start, stop, reduction, differences)."""
        key = tuple(words)
        if key not in self.known:
            self.held += len(key)
            if self.held > WORDS_KEPT:
                self.known.clear()
                self.held = len(key)
            tried, other = [], []
            for reduction, k in self.candidates(words):
                agreement, differences, start, stop = self.compare(words, k)
                if agreement >= self.agree:
                    # A longer wording that agrees is worth more than a shorter one inside it.
                    (tried if self.same_license(words, k, start, stop) else other).append((len(differences) - (stop - start), -reduction, k, start, stop, differences))
            self.known[key] = None
            if tried or other:
                _, reduction, k, start, stop, differences = min(tried or other)
                self.known[key] = self.names[k] if tried else f"unknown (nearest {self.names[k]})", start, stop, -reduction, differences
        return self.known[key]

    def block(self, words: list[str]) -> list[tuple[str, int, int, float, list[str]]]:
        """(license, start, stop, reduction, differences) of the notices in a block of words, in order; time grows with the block's length."""
        found, at = [], 0
        while at < len(words):
            last = at + self.piece >= len(words)
            edge = len(words) if last else at + self.piece - self.room
            own = [(n, at + a, at + b, r, d) for n, a, b, r, d in self.notices(words[at : at + self.piece]) if at + a < edge]
            found += own
            at = max(edge, max((f[2] for f in own), default=0))
        return found

    def notices(self, words: list[str]) -> list[tuple[str, int, int, float, list[str]]]:
        """``block`` for a piece of bounded length."""
        found, waiting = [], [(0, len(words))]
        while waiting:
            low, high = waiting.pop()
            own = words[low:high]
            best = self.winner(own) if len(own) >= FEWEST else None
            if not best:
                continue
            name, start, stop, reduction, differences = best
            # No longer wording fits here, so that its exact repeats are the same notice.
            wording, size, at, last = own[start:stop], stop - start, 0, 0
            while at + size <= len(own):
                if at == start or (at + size <= start or at >= stop) and own[at : at + size] == wording:
                    found.append((name, low + at, low + at + size, reduction, differences))
                    waiting.append((low + last, low + at))
                    at = last = at + size
                else:
                    at += 1
            waiting.append((low + last, high))
        return sorted(found, key=lambda f: f[1])

    def scan(self, text: str) -> tuple[int, list[tuple[str, int, int, float, list[str]]]]:
        """The number of candidate blocks and the notices of a text: (license, first and last character, reduction, differences)."""
        low = text.lower()
        if not any(c in low for c in CUES):
            return 0, []
        if len(low) != len(text):  # places must be those of the text
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        blocks, run, cued = [], [], False
        for unit in UNIT.finditer(low):
            words = [(m[0], unit.start() + m.start(), unit.start() + m.end()) for m in WORD.finditer(unit[0])]
            if not words:
                continue
            cue = any(c in unit[0] for c in CUES)
            if cue or 2 * sum(w in self.vocabulary for w, _, _ in words) > len(words):
                run += words
                cued |= cue
            else:
                if cued:
                    blocks.append(run)
                run, cued = [], False
        if cued:
            blocks.append(run)
        found = []
        for words in blocks:
            found += [(n, words[a][1], words[b - 1][2], r, d) for n, a, b, r, d in self.block([w for w, _, _ in words])]
        return len(blocks), found


FINDING = pa.struct([("license", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("reduction", pa.float64()), ("differences", pa.list_(pa.string()))])


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, candidates, findings) of every row of ``docs`` (doc_id, text); findings are structs (license, start, stop, reduction, differences)."""

    def run(batches):
        own = Scanner(templates)
        for batch in batches:
            rows = [own.scan(t.as_py() or "") for t in batch.column(1)]
            findings = [[dict(zip(("license", "start", "stop", "reduction", "differences"), f, strict=True)) for f in found] for _, found in rows]
            columns = [batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array(findings, pa.list_(FINDING))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "candidates", "findings"])

    schema = "doc_id long, candidates long, findings array<struct<license:string,start:long,stop:long,reduction:double,differences:array<string>>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
