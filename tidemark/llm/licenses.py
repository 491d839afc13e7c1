"""Licence scans by canonical digest lookup, in DataFrame functions only.

A text is normalised (case, punctuation, lines of copyright notices, equivalent spellings of whole
words) and its SHA-256 is joined to the digests of the known licence texts: the texts of this module and
the longer ones in the folder ``license_texts``, with and without the appendix after their terms. Beside
that, each line of a text is normalised the same way and joined to the digests of one-line notices,
which usually stand inside other prose.

A copyright line is one that goes on as a notice does, with a sign, a year, a place for one, or "by";
a clause that begins with "(c)" is none, so texts with different clauses have different digests.

Defined cases: a null or empty text, or one that normalises to nothing, matches no licence; rows are told
apart by a digest of id and text, repeated rows give repeated results; of two known texts with one digest
the lesser name counts; a very long text is hashed whole; other columns are ignored, clashing names
included; an empty table gives an empty result.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load, row_key, staged

# Public licence texts and notices, as published, without their copyright lines.
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO_BSD_BODY = _ISC_BODY.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL3_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_ZLIB_BODY = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
#: Where the terms of a longer text end; what follows tells how to apply it and is often left out.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def _long_texts() -> list[tuple[str, str]]:
    """(licence, text) of the files beside this module, whole and up to the end of their terms."""
    out = []
    for file in sorted(resources.files("tidemark.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name):
        text = file.read_text(encoding="utf-8")
        head, mark, _ = text.partition(END_OF_TERMS)
        out += [(file.name.removesuffix(".txt"), t) for t in ([text, head + mark, head] if mark else [text])]
    return out


KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("ISC", _ISC_BODY),
    ("ISC", "ISC License\n\n" + _ISC_BODY),
    ("0BSD", _ZERO_BSD_BODY),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Apache-2.0", _APACHE_HEADER),
    ("GPL-3.0-or-later", _GPL3_HEADER),
    ("Zlib", _ZLIB_BODY),
    ("Unlicense", _UNLICENSE),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    *_long_texts(),
]

# Words and phrases that licence matching treats as the same, left to right.
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("creative commons attribution", "cc by"),
    ("https", "http"),
]
# One-line notices and the licence each one names.
NOTICES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]
#: A line of a notice: the word or sign with a sign, a year, a place for one, or "by". A wrapped line of prose is none.
NOTICE_LINE = r"^[^a-z0-9\n]*(©|(copyright|\(c\))[ \t:,]*(\(c\)|©|[0-9]{4}|[<\[{(]?(year|yyyy)\b|by\b))[^\n]*$"
SEPARATORS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Between words while spellings are replaced, so that each word has both its spaces.
GAP = "  "


def canonical(text: Column) -> Column:
    """Lower case without copyright lines, other characters as single spaces, spellings of whole words unified."""
    # Lines end at \n alone, in both engines.
    out = F.regexp_replace(F.lower(text), "(?md)" + NOTICE_LINE, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, SEPARATORS, GAP), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, *[F.lit(f" {x.replace(' ', GAP)} ") for x in (old, new)])
    return F.trim(F.replace(out, F.lit(GAP), F.lit(" ")))


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """(digest, license_id) of the known texts, one row per digest."""
    rows = spark.createDataFrame(known, "license_id string, known_text string")
    return rows.groupBy(F.sha2(canonical(F.col("known_text")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, notices: list[tuple[str, str]] = NOTICES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: the digest of its whole canonical text, the licence it is, and the licences its lines name.

    Whole texts are joined to the known digests, and the different lines of each text to the digests of
    notices. Both tables are lists of this module, a few hundred rows of 64 characters whatever the corpus,
    so they are broadcast and no text is shuffled.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("doc_id"), row_key(id_column, text_column).alias("row"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    lines = rows.select("row", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).filter(F.length("line") > 0)
    noticed = lines.select("row", F.sha2(canonical(F.col("line")), 256).alias("digest")).join(F.broadcast(known_digests(spark, notices)), "digest")
    named = staged(noticed.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notice_ids")), "notices")
    marked = rows.select("doc_id", "row", canonical(F.col("text")).alias("canon")).select("doc_id", "row", F.sha2("canon", 256).alias("canonical_sha256"), F.length("canon").cast("long").alias("canonical_chars"))
    whole = marked.join(F.broadcast(known_digests(spark, known).withColumnRenamed("digest", "canonical_sha256")), "canonical_sha256", "left")
    return whole.join(named, "row", "left").select("doc_id", "canonical_sha256", "canonical_chars", "license_id", F.coalesce("notice_ids", F.lit("")).alias("notice_ids"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower({text}), {_sql_text('(?m)' + NOTICE_LINE)}, ' ', 'g')"
    out = f"' ' || regexp_replace({out}, {_sql_text(SEPARATORS)}, '{GAP}', 'g') || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_sql_text(' ' + old.replace(' ', GAP) + ' ')}, {_sql_text(' ' + new.replace(' ', GAP) + ' ')})"
    return f"trim(replace({out}, '{GAP}', ' '))"


def _digests_sql(known: list[tuple[str, str]]) -> str:
    rows = ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in known)
    return f"SELECT sha256({_canonical_sql('known_text')}) AS digest, min(license_id) AS license_id FROM (VALUES {rows}) AS k(license_id, known_text) GROUP BY 1"


SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
known AS ({_digests_sql(KNOWN)}),
notices AS ({_digests_sql(NOTICES)}),
canon AS (SELECT doc_id, {_canonical_sql('text')} AS canon FROM texts),
lines AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts),
found AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notice_ids
  FROM lines JOIN notices ON sha256({_canonical_sql('line')}) = notices.digest GROUP BY doc_id
)
SELECT c.doc_id, sha256(canon) AS canonical_sha256, length(canon)::BIGINT AS canonical_chars,
       k.license_id, coalesce(f.notice_ids, '') AS notice_ids
FROM canon c LEFT JOIN known k ON sha256(c.canon) = k.digest LEFT JOIN found f USING (doc_id)
"""
