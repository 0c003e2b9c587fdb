"""Licence scans by canonical digests.

A text is brought to a canonical form: lower case, equivalent spellings made one, copyright
lines and punctuation dropped. The digest of the whole canonical text is joined with the
digests of known licences. Texts looked up are a document, each of its paragraphs and each
of its lines. Known texts are also sought as runs of whole lines, however those are wrapped
and cut into paragraphs, so a licence that stands inside a document is found as well.
"""

from __future__ import annotations

import hashlib
import pkgutil
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.rows import text_key
from fathomline.storage import materialise

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""

BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.
"""
BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""

UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and
all copyright interest in the software to the public domain. We make this dedication for the benefit of the
public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt
act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
UNLICENSE_LINK = "\n\nFor more information, please refer to <https://unlicense.org>"

GNU_NOTICE = """This program is free software{colon} you can redistribute it and/or modify it under the terms of
the GNU General Public License as published by the Free Software Foundation{comma} either version {version} of the
License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
for more details.
"""
GNU_COPY = """
You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""

MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def _file(name: str) -> str:
    return pkgutil.get_data(__package__, f"licence_texts/{name}.txt").decode()


def _unnumbered(text: str) -> str:
    return re.sub(r"(?m)^[0-9]\. ", "", text)


_BSD_2, _BSD_3 = BSD_CONDITIONS + BSD_DISCLAIMER, BSD_CONDITIONS + BSD_NAMES + BSD_DISCLAIMER
_GNU = GNU_NOTICE.format(colon=":", comma=",", version="{version}") + GNU_COPY

#: names and texts; several texts may have one name
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    ("Apache-2.0", _file("Apache-2.0")),
    ("Apache-2.0", _file("Apache-2.0").partition("   APPENDIX:")[0]),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-2-Clause", _unnumbered(_BSD_2)),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", _unnumbered(_BSD_3)),
    ("BSD-3-Clause", _file("BSD")),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC0-1.0", _file("CC0-1.0")),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("GPL-2.0", _file("GPL-2")),
    ("GPL-2.0", _GNU.format(version=2)),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", _file("GPL-3")),
    ("GPL-3.0", _GNU.format(version=3)),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-2.1", _file("LGPL-2.1")),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL-3.0", _file("LGPL-3")),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("MPL-2.0", _file("MPL-2.0")),
    ("MPL-2.0", MPL_NOTICE),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", UNLICENSE),
    ("Unlicense", UNLICENSE + UNLICENSE_LINK),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
)

#: titles in canonical form that may stand before the text of a whole document
TITLES = {
    "mit license", "the mit license", "the mit license mit", "mit license mit", "isc license", "the isc license", "isc license isc",
    "bsd 2 clause license", "the 2 clause bsd license", "simplified bsd license", "bsd 3 clause license", "the 3 clause bsd license",
    "new bsd license", "bsd license", "the unlicense", "unlicense",
}

#: spellings that count as one, as patterns over lower-cased text
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("licencing", "licensing"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("https:", "http:"),
)
COPYRIGHT_LINE = (
    r"(?m)^[^\n0-9A-Za-z]*(?:copyright:? (?:\(c\)|\x{A9}|[0-9]|[\[<{]"
    r"|the [^\n]*(?:authors|contributors|developers|maintainers|team|project|foundation))"
    r"|\(c\) |\x{A9}|all rights reserved[^\n0-9A-Za-z]*$)[^\n]*$"
)


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, words separated by one space."""
    text = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for given, one in SPELLINGS:
        text = F.replace(text, F.lit(given), F.lit(one))
    return F.trim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A9}]+", " "))


def known_forms(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """``(form, licence)`` of the known texts; of equal forms the first name counts."""
    frame = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(known)], "place int, licence string, text string")
    forms = frame.select("place", "licence", canonical(F.col("text")).alias("form"))
    return forms.groupBy("form").agg(F.min(F.struct("place", "licence"))["licence"].alias("licence"))


def telling_words(forms: list[str]) -> list[str]:
    """Words of which a text has at least one, in lower case, if its form is known.

    Of every form the longest word that no spelling rule can have made or changed; a form
    without such a word gives the empty word, which every text has.
    """
    ruled = {w for _, one in SPELLINGS for w in re.findall(r"[a-z]+", one)}
    found = set()
    for form in forms:
        own = [w for w in form.split(" ") if not any(r in w or w in r for r in ruled)]
        found.add(max(own, key=lambda w: (len(w), w), default=""))
    return sorted(found)


def _may_hold(text: Column, telling: list[str]) -> Column:
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, (lowered.contains(w) for w in telling), F.lit(False))


def _paragraph_spans(text: str, lines: list[str]) -> set[tuple[int, int]]:
    """First and last line with words of every paragraph that is looked up on its own."""
    spans, at = set(), 0
    for paragraph in re.split(r"\n[ \t\r]*\n", text):
        n = paragraph.count("\n") + 1
        held = [i for i in range(at, at + n) if lines[i]]
        if n > 1 and held:
            spans.add((held[0], held[-1]))
        at += n + 1
    return spans


def _joined_spellings(lines: list[str]) -> list[str]:
    """Spellings of two words that a line's end parts are made one as well."""
    pairs = [(*given.split(" "), one) for given, one in SPELLINGS if " " in given]
    lines, last = list(lines), None
    for i, line in enumerate(lines):
        if not line:
            continue
        for first, second, one in pairs if last is not None else ():
            before = lines[last]
            if f" {before}".endswith(f" {first}") and re.match(rf"{second}", line):
                lines[last], lines[i] = before[: len(before) - len(first)] + one + line[len(second) :].partition(" ")[0], line.partition(" ")[2]
                break
        last = i if lines[i] else last
    return lines


def _runs(forms: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``(doc_id, key, text, lines)`` to the known texts found as runs of lines.

    ``lines`` are the canonical lines. A run that is one line or one paragraph is left out,
    these are looked up by digest; ``whole`` tells that only a title stands beside a run.
    """

    def found_in(text: str, lines: list[str]) -> Iterator[tuple[bool, str]]:
        spans = None
        own = _joined_spellings(lines)
        starts, ends, at = {}, {}, 0
        for i, line in enumerate(own):
            if line:
                starts[at], ends[at + len(line)] = i, i
                at += len(line) + 1
        flat = " ".join(line for line in own if line)
        for form, licence in forms.items():
            at = flat.find(form)
            while at >= 0:
                end = at + len(form)
                if at in starts and end in ends:
                    first, last = starts[at], ends[end]
                    if end == len(flat) and (at == 0 or flat[: at - 1] in TITLES):
                        yield True, licence
                    if first < last:
                        spans = spans or _paragraph_spans(text, lines)
                        plain = " ".join(line for line in lines[first : last + 1] if line)
                        if (first, last) not in spans or plain != form:
                            yield False, licence
                at = flat.find(form, at + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts, lines = (batch.column(c).to_pylist() for c in ("doc_id", "key", "text", "lines"))
            hits = [(i, k, w, n) for i, k, t, own in zip(ids, keys, texts, lines) for w, n in found_in(t, own)]
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.string())
            columns = [pa.array([h[c] for h in hits], t) for c, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "whole", "licence"])

    return run


def scan_licences(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """``(doc_id, licence, n_hits, licences)`` for every row of ``docs``.

    ``licence`` is the name of the document's whole text but for a title, null if it is no
    known licence; ``n_hits`` counts the paragraphs and lines that are known, a paragraph of
    one line once, and the other runs of whole lines that are; ``licences`` are the distinct names found, sorted and joined by commas, empty if
    there are none.

    Null and empty texts hit nothing, nor does a text that is empty in canonical form.
    Rows that repeat id and text get equal results; rows without an id get theirs too. An
    empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    forms = known_forms(docs.sparkSession, known).collect()  # part of the program
    telling = telling_words([r["form"] for r in forms])
    digests = docs.sparkSession.createDataFrame(
        [(hashlib.sha256(r["form"].encode()).hexdigest(), r["licence"]) for r in forms], "digest string, licence string"
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), text.alias("text"))
    paragraphs = F.filter(F.split("text", r"\n[ \t\r]*\n"), lambda p: p.contains("\n"))
    units = F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("unit"))),
        F.transform(F.concat(paragraphs, F.split("text", "\n")), lambda u: F.struct(F.lit(False).alias("whole"), u.alias("unit"))),
    )
    # texts without a telling word cannot have a known form, so they are not brought to it
    held = rows.where(_may_hold(F.col("text"), telling))
    looked_up = held.select("doc_id", "key", F.explode(units).alias("u")).select("doc_id", "key", "u.*")
    hits = (
        looked_up.where(_may_hold(F.col("unit"), telling))
        .select("doc_id", "key", "whole", F.sha2(canonical(F.col("unit")), 256).alias("digest"))
        # as many rows as there are known texts
        .join(F.broadcast(digests), "digest")
        .select("doc_id", "key", "whole", "licence")
    )
    lines = F.transform(F.split("text", "\n"), canonical)
    run = _runs({r["form"]: r["licence"] for r in forms if r["form"]})
    hits = hits.unionByName(
        held.select("doc_id", "key", "text", lines.alias("lines"))
        .mapInArrow(run, "doc_id long, key long, whole boolean, licence string")
    )
    # rows that repeat id and text meet in one group; the join below divides by their number
    per_row = hits.groupBy("doc_id", "key").agg(
        F.max(F.when(F.col("whole"), F.col("licence"))).alias("licence"),
        F.sum(F.when(F.col("whole"), 0).otherwise(1)).alias("total"),
        F.collect_set("licence").alias("names"),
    )
    per_row = materialise(per_row, "licence-hits")
    return _joined(rows.select("doc_id", "key"), per_row)


def _joined(rows: DataFrame, per_row: DataFrame) -> DataFrame:
    counted = rows.groupBy("doc_id", "key").agg(F.count("*").alias("copies"))
    counted = counted.alias("r").join(
        per_row.alias("h"),
        F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("r.key") == F.col("h.key")),
        "left",
    )
    names = F.array_sort(F.coalesce("names", F.array().cast("array<string>")))
    return counted.select(
        F.col("r.doc_id").alias("doc_id"),
        "licence",
        F.coalesce((F.col("total") / F.col("copies")).cast("long"), F.lit(0).cast("long")).alias("n_hits"),
        F.array_join(names, ",").alias("licences"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
