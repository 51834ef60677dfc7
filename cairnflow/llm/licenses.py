"""License scan by canonical digest lookup, in DataFrame operations only.

A text is brought to a canonical form: lower case, copyright lines removed, spellings that mean the same made
one, everything but letters and digits turned into single spaces. The SHA-256 of the whole form is hash-joined with
the digests of known licence texts. Lines that speak of a licence are put into the same form one by one and
joined with the digests of known notices, so that a document that only carries a notice is found too.

Nulls and empty texts have the digest of the empty form and match nothing. A digest names one licence (the
smallest id), so matches never multiply rows; repeated rows each get their own result, empty tables an empty
one. Other columns of the documents are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence matching treats as equal, as (pattern, replacement), applied in this order.
EQUIVALENT = (
    ("licence", "license"),
    ("(organ|author|recogn|util|modern|custom|initial|general|real)is(e|ed|es|ing|ation)\\b", "$1iz$2"),
    ("\\b(fav|col|hon|behavi)our", "$1or"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("sub[ -]license", "sublicense"),
    ("non[ -]?(commercial|infringement)", "non$1"),
    ("merchantibility", "merchantability"),
    ("fulfilment", "fulfillment"),
    ("copyright (holder|owner)", "copyright owner"),
    ("http://", "https://"),
)

COPYRIGHT_LINE = "(?m)^[ \\t*#/;-]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*$"
SEPARATORS = "[^\\p{L}\\p{N}]+"
#: A line with this in it is a candidate notice.
NOTICE_CUE = "licen"

# Standard licence texts, without their copyright lines.
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""

BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""

APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

# One-line notices.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
)


def known_texts() -> list[tuple[str, str]]:
    """(licence id, text): a fixed list, so that its digests may be broadcast."""
    without_title = lambda t: t.partition("\n\n")[2]
    return [
        ("0BSD", "Zero-Clause BSD\n\n" + without_title(ISC).replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
        ("Apache-2.0-header", APACHE_HEADER),
        ("BSD-2-Clause", f"{BSD_TERMS}\n\n{BSD_END}"),
        ("BSD-2-Clause", f"BSD 2-Clause License\n\n{BSD_TERMS}\n\n{BSD_END}"),
        ("BSD-3-Clause", f"{BSD_TERMS}\n\n{BSD_THIRD}\n\n{BSD_END}"),
        ("BSD-3-Clause", f"BSD 3-Clause License\n\n{BSD_TERMS}\n\n{BSD_THIRD}\n\n{BSD_END}"),
        ("GPL-2.0-header", GPL_HEADER.format(v=2)),
        ("GPL-3.0-header", GPL_HEADER.format(v=3)),
        ("ISC", ISC),
        ("ISC", without_title(ISC)),
        ("MIT", MIT),
        ("MIT", without_title(MIT)),
        ("MIT", f"The MIT License\n\n{without_title(MIT)}"),
        ("MIT", f"The MIT License (MIT)\n\n{without_title(MIT)}"),
        ("Unlicense", UNLICENSE),
        ("Zlib", ZLIB),
        ("Zlib", f"zlib License\n\n{ZLIB}"),
    ]


def canonical(text):
    """Column: the canonical form of a text column."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for pattern, to in EQUIVALENT:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(out, SEPARATORS, " "))


def digests(spark: SparkSession, texts: list[tuple[str, str]], name: str, key: str) -> DataFrame:
    """One row a digest: the smallest id whose text has it."""
    rows = spark.createDataFrame(texts, f"{name} string, t string")
    return rows.select(F.sha2(canonical(F.col("t")), 256).alias(key), name).groupBy(key).agg(F.min(name).alias(name))


def known_digests(texts: DataFrame) -> DataFrame:
    """text_sha256, license_id of a table (license_id, text) of known texts, of any size; the smallest id of equal texts."""
    return texts.where("text is not null").select(
        F.sha2(canonical(F.col("text")), 256).alias("text_sha256"),
        "license_id",
    ).groupBy("text_sha256").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, texts: list[tuple[str, str]] | DataFrame | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, text_sha256, license_id (null: unknown), n_notice_lines, notice_ids (sorted, comma-joined) of each document."""
    spark = docs.sparkSession
    # a list has a bound and is broadcast; how a table is joined depends on its size
    known = known_digests(texts) if isinstance(texts, DataFrame) else F.broadcast(digests(spark, known_texts() if texts is None else texts, "license_id", "text_sha256"))
    listed = list(NOTICES) if notices is None else notices
    lines = digests(spark, listed, "notice_id", "line_sha256")
    # the notices are a fixed list: as a map literal they cost no join and no row a line
    found = F.map_from_entries(F.array(*[F.struct(F.lit(r["line_sha256"]), F.lit(r["notice_id"])) for r in lines.collect()])) if listed else F.create_map().cast("map<string,string>")
    text = F.coalesce(F.col("text"), F.lit(""))
    cued = F.when(F.lower(text).contains(NOTICE_CUE), F.filter(F.split(text, "\n"), lambda x: F.lower(x).contains(NOTICE_CUE))).otherwise(F.array().cast("array<string>"))
    ids = F.filter(F.transform(cued, lambda x: F.element_at(found, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())
    rows = docs.select("doc_id", F.sha2(canonical(text), 256).alias("text_sha256"), ids.alias("ids"))
    return rows.join(known, "text_sha256", "left").select(
        "doc_id",
        "text_sha256",
        "license_id",
        F.size("ids").cast("long").alias("n_notice_lines"),
        F.array_join(F.array_sort(F.array_distinct("ids")), ",").alias("notice_ids"),
    )


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(expr: str) -> str:
    out = f"regexp_replace(lower({expr}), {_sql(COPYRIGHT_LINE)}, '', 'g')"
    for pattern, to in EQUIVALENT:
        out = f"regexp_replace({out}, {_sql(pattern)}, {_sql(to.replace('$', chr(92)))}, 'g')"
    return f"trim(regexp_replace({out}, {_sql(SEPARATORS)}, ' ', 'g'))"


def oracle() -> str:
    texts = ", ".join(f"({_sql(i)}, {_sql(t)})" for i, t in known_texts())
    notices = ", ".join(f"({_sql(i)}, {_sql(t)})" for i, t in NOTICES)
    return f"""
WITH known AS (SELECT sha256({_canonical_sql('t')}) AS h, min(i) AS license_id FROM (VALUES {texts}) v(i, t) GROUP BY 1),
notices AS (SELECT sha256({_canonical_sql('t')}) AS h, min(i) AS notice_id FROM (VALUES {notices}) v(i, t) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d WHERE contains(lower(text), '{NOTICE_CUE}')),
hits AS (SELECT rid, count(*) AS n, string_agg(DISTINCT notice_id, ',' ORDER BY notice_id) AS ids
  FROM (SELECT rid, sha256({_canonical_sql('line')}) AS h FROM lines WHERE contains(lower(line), '{NOTICE_CUE}')) JOIN notices USING (h) GROUP BY rid),
t AS (SELECT rid, doc_id, sha256({_canonical_sql('text')}) AS text_sha256 FROM d)
SELECT t.doc_id, t.text_sha256, known.license_id, coalesce(hits.n, 0) AS n_notice_lines, coalesce(hits.ids, '') AS notice_ids
FROM t LEFT JOIN known ON known.h = t.text_sha256 LEFT JOIN hits USING (rid)"""
