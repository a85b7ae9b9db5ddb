"""License scans: entire texts looked up by the digest of a canonical form.

A text is brought to canonical form (lower case, copyright lines removed,
punctuation and white space collapsed, equivalent spellings unified), its SHA-256
is taken and hash-joined to the digests of known licences and notices.  Whole
documents and single lines are both entire texts here: a licence file matches as
a document, a notice such as "Released under the MIT License." as a line.

Everything is a DataFrame expression.  The known side is broadcast only while it
is below ``BROADCAST_ROWS``; beyond that Spark joins by shuffle.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known digests are broadcast up to this many rows of about 100 bytes.
BROADCAST_ROWS = 100_000

#: Whole words that mean the same, replaced in order in canonical text.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("licencing", "licensing"),
    ("licencor", "licensor"),
    ("licencors", "licensors"),
    ("licencee", "licensee"),
    ("licencees", "licensees"),
    ("sublicence", "sublicense"),
    ("sublicences", "sublicenses"),
    ("sublicenced", "sublicensed"),
    ("sublicencing", "sublicensing"),
    ("sublicencee", "sublicensee"),
    ("sublicencees", "sublicensees"),
    ("relicencing", "relicensing"),
    ("sub license", "sublicense"),
    ("creative commons attribution noncommercial", "cc by nc"),
    ("creative commons attribution non commercial", "cc by nc"),
    ("creative commons attribution", "cc by"),
    ("gnu general public license", "gpl"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("per cent", "percent"),
    ("version 1", "v1"),
    ("version 2", "v2"),
    ("version 3", "v3"),
    ("version 4", "v4"),
]

#: Pieces of canonical text before spellings, one of which stands in every phrase that is replaced.
STEMS = ["licenc", "sub  license", "creative  commons", "gnu  general", "copyright  holder", "merchantibility", "non  infringement", "per  cent", "version  "]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""

_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Known licences and notices, as (identifier, text).  Callers may pass their own list.
KNOWN = [
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", _MIT),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", _ISC),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Zlib", _ZLIB),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD2 + _BSD_END),
    ("BSD-2-Clause", _BSD2 + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD2 + _BSD3 + _BSD_END),
    ("BSD-3-Clause", _BSD2 + _BSD3 + _BSD_END),
    ("Unlicense", _UNLICENSE),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
]

#: SHA-256 digests of the canonical form of longer licences, as published, whole.
FULL_TEXTS = [
    ("Apache-2.0", "37c52c6ebfb3075ab914143702993d44ac6a131cbf9e27086ec0a6e134510060"),
    ("Artistic-1.0", "206a10be95791fc6960db067debc11f3b4e4146d640ebccac83b15cb6a75c72b"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "d8096b93a40a1e01766a43326e77cd7b82ea26706198b0b061fd9e6ddc5b5234"),
    ("GFDL-1.3", "ae7a2b73b57e704f3a1221b85497a5d5b91a6767e619c9bbf94c0c5f983f946d"),
    ("GPL-1.0", "101a24ff1944316fbd55f669746aef170936044934f8e2ceda271996a4bf2b6f"),
    ("GPL-2.0", "c09136fa01d4e15a62d1f0e89ea5482dfc6a951b4f72150257b6e8e8af42ee48"),
    ("GPL-3.0", "4f324d56e8d5a28541f6dd93120462b88a30b30f18783aff33f4ef53d91ee378"),
    ("LGPL-2.0", "96ddc5318337717590c4f1119b13e9d45a582c93ecf96e5c5d91d94d99550780"),
    ("LGPL-2.1", "5a94f8bacaa1f09875b861479d63cdc0b7243480928c89533e872546111a8e6d"),
    ("LGPL-3.0", "4df2d113ee825ef23660104d6f246ff8ed2b29136e2cd6808361a218967aa148"),
    ("MPL-1.1", "ea86b8706eaa54ae6772e73b8999c32089d18d7d1f9daa08fae518eaecfcbc61"),
    ("MPL-2.0", "0a7f9eb0a730c04083788cfc36c570f83e858f4c1d9d461cbd87a22eb28c3921"),
]

#: A line that states a copyright and nothing of a licence.
COPYRIGHT_LINE = r"(?m)^[^\n]{0,8}(copyright|\(c\)|©)[^\n]{0,4}(\(c\)|©|[0-9]{4}|copyright|by )[^\n]*$"


def canonical(text: Column) -> Column:
    """The form whose digest is looked up; equal licences that differ in case, punctuation, copyright lines or spelling agree."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    # two blanks between words, so that each word has its own on both sides
    out = F.concat(F.lit(" "), F.regexp_replace(out, "[^a-z0-9\\x{80}-\\x{10FFFF}]+", "  "), F.lit(" "))
    whole = out
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    # without a stem nothing is replaced first, so nothing at all; most texts are spared the replacements
    stemmed = functools.reduce(Column.__or__, (F.contains(whole, F.lit(x)) for x in STEMS))
    out = F.when(stemmed, out).otherwise(whole)
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """Digest and identifier of each known text, of the default list with the longer ones; texts that agree keep the smallest identifier."""
    rows = spark.createDataFrame(known or KNOWN, "license_id string, text string").select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id")
    if not known:
        rows = rows.union(spark.createDataFrame([(d, i) for i, d in FULL_TEXTS], "digest string, license_id string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(df: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", known_rows: int | None = None) -> DataFrame:
    """Every entire text that is a known licence: id, unit (``document`` or ``line``), line_no, license_id, digest.

    The whole text counts as line 0; a text of several lines also offers each line,
    from 1.  Null and empty texts match nothing.  Repeated rows are each reported,
    an empty table gives an empty result, and other columns are ignored.
    ``known_rows`` is the known side's size where the caller passes one.
    """
    spark = df.sparkSession
    if known is None:
        known, known_rows = known_digests(spark), len(KNOWN) + len(FULL_TEXTS)
    text = F.col("_t")
    units = F.when(F.instr(text, "\n") > 0, F.concat(F.array(text), F.split(text, "\n"))).otherwise(F.array(text))
    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_t")).where(F.col("_t").isNotNull())
    rows = rows.select(id_col, F.posexplode(units).alias("line_no", "_unit")).where(F.length("_unit") > 0)
    # units are never null; a digest that could be is made a second time to see whether it is
    digest = F.coalesce(F.sha2(canonical(F.col("_unit")), 256), F.lit(""))
    rows = rows.select(id_col, F.when(F.col("line_no") == 0, "document").otherwise("line").alias("unit"), F.col("line_no").cast("long").alias("line_no"), digest.alias("digest"))
    small = known_rows is not None and known_rows <= BROADCAST_ROWS
    return rows.join(F.broadcast(known) if small else known, "digest").select(id_col, "unit", "line_no", "license_id", "digest")


def oracle_sql(known: list[tuple[str, str]] | None = None) -> str:
    """The same scan of ``documents`` as DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(col: str) -> str:
        out = f"regexp_replace(lower({col}), {quote(COPYRIGHT_LINE.replace('(?m)', '(?m)'))}, ' ', 'g')"
        out = f"' ' || regexp_replace({out}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', '  ', 'g') || ' '"
        for a, b in SPELLINGS:
            x, y = (f" {w.replace(' ', '  ')} " for w in (a, b))
            out = f"replace({out}, {quote(x)}, {quote(y)})"
        return f"trim(replace({out}, '  ', ' '))"

    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in known or KNOWN)
    more = ", ".join(f"({quote(i)}, {quote(d)})" for i, d in ([] if known else FULL_TEXTS)) or "(NULL, NULL)"
    return f"""
WITH known AS (SELECT digest, min(license_id) AS license_id FROM (
  SELECT license_id, sha256({form("text")}) AS digest FROM (VALUES {values}) v(license_id, text)
  UNION ALL SELECT license_id, digest FROM (VALUES {more}) w(license_id, digest)) WHERE digest IS NOT NULL GROUP BY 1),
units AS (
  SELECT doc_id, 'document' AS unit, 0 AS line_no, text AS u FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, 'line', unnest(range(1, len(string_split(text, chr(10))) + 1)), unnest(string_split(text, chr(10)))
  FROM documents WHERE contains(text, chr(10)))
SELECT doc_id, unit, CAST(line_no AS BIGINT) AS line_no, license_id, digest
FROM (SELECT doc_id, unit, line_no, sha256({form("u")}) AS digest FROM units WHERE length(u) > 0) JOIN known USING (digest)"""
