"""Licence scan: canonical text digests joined to the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import whole

# Licences by identifier and name, the sentences that notices are made of, full texts, and spellings that
# licence guidelines treat as equal.
NAMES = (
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("EPL-2.0", "Eclipse Public License 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
)
SHORT_NAMES = (
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC0-1.0", "CC0 1.0"),
)
SENTENCES = (
    "Licensed under",
    "Released under",
    "Distributed under",
    "This work is licensed under",
    "This project is licensed under",
    "This software is licensed under",
)
SPDX = (
    "0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only",
    "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib",
)
NOTICES = (
    *((name, f"{start} the {full}.") for name, full in NAMES for start in SENTENCES),
    *((name, f"{start} {full}.") for name, full in SHORT_NAMES for start in SENTENCES),
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX),
)
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = (
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
""" + _BSD_END),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS
IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
)
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("organisation", "organization"),
    ("copy right owner", "copy right holder"), ("copy right owners", "copy right holders"), ("https", "http"),
)

#: Copyright as a licence text speaks of it, not a statement of one wherever the line breaks; a notice that follows a
#: copyright clause on its line, what is left of a line that states a copyright, and what is
#: neither letter, digit nor line end. All also hold in SQL engines with linear-time expressions.
SPOKEN_OF = r"copyright([ \t\n]+(?:notice|holder|owner|law|interest|license))"
NOTICE_AFTER = (
    r"((?:^|\n)[^\na-z0-9]*(?:copyright[^a-z0-9\n]|\(c\)|all rights reserved)[^\n]*?[.;,:]) +"
    r"((?:(?:released|distributed|licen[cs]ed) under|this (?:work|project|software) is licen[cs]ed|spdx-licen[cs]e-identifier)[^\n]*)"
)
COPYRIGHT_LINE = r"(^|\n)[^\na-z0-9]*(copyright[^a-z0-9\n]|\(c\)|all rights reserved)[^\n]*"
PUNCTUATION = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"

#: Known digests are broadcast; a longer list is refused.
MAX_KNOWN = 10_000


def canonical_lines(text: Column) -> Column:
    """Lower case, no copyright lines, punctuation as single spaces, one spelling; line ends stay, between spaces.

    A notice behind a copyright clause becomes a line of its own.
    """
    out = F.regexp_replace(F.lower(text), SPOKEN_OF, "copy right$1")
    out = F.regexp_replace(out, NOTICE_AFTER, "$1\n$2")
    out = F.regexp_replace(out, COPYRIGHT_LINE, "\n")
    out = F.replace(F.regexp_replace(out, PUNCTUATION, " "), F.lit("\n"), F.lit(" \n "))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for variant, spelling in SPELLINGS:
        out = F.replace(out, F.lit(f" {variant} "), F.lit(f" {spelling} "))
    return out


def one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def known_digests(spark: SparkSession, licences: tuple[tuple[str, str], ...] = NOTICES + TEXTS) -> DataFrame:
    """(digest, license): one row per canonical text."""
    rows = spark.createDataFrame(list(licences), "license string, body string")
    return rows.groupBy(F.md5(one_line(canonical_lines(F.col("body")))).alias("digest")).agg(
        F.min("license").alias("license")
    )


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, text_license, line_licenses, text_md5 for every row of ``docs``.

    ``text_license`` is the licence whose whole canonical text is the document's whole canonical text, else null.
    ``line_licenses`` lists, comma-joined in order and once each, the licences whose canonical text is a whole line of
    the document ("" if none): short notices stand on a line of their own or behind a copyright clause. ``text_md5``
    is the digest of the document's canonical text. Null counts as empty; empty and punctuation-only texts match
    nothing; repeated rows give repeated rows; very long texts are read whole; an empty table gives an empty result;
    other columns are ignored.

    Whole texts meet the known digests in a hash join, lines in a hash set and the few found there in a constant map. All
    hold at most ``MAX_KNOWN`` digests, so they may be broadcast; documents are not shuffled, whatever their size and however frequent a licence is.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    pairs = known.limit(MAX_KNOWN + 1).collect()
    if len(pairs) > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known licence digests")
    by_digest = F.map_from_arrays(
        F.array(*[F.lit(r["digest"]) for r in pairs]).cast("array<string>"),
        F.array(*[F.lit(r["license"]) for r in pairs]).cast("array<string>"),
    )
    rows = docs.select("doc_id", canonical_lines(whole("text")).alias("lines"))
    digests = F.transform(F.split("lines", "\n"), lambda line: F.md5(F.trim(line)))
    met = F.array_distinct(F.filter(digests, lambda d: d.isin([r["digest"] for r in pairs])))
    names = F.transform(met, lambda d: F.element_at(by_digest, d))
    rows = rows.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("line_licenses"),
        F.md5(one_line(F.col("lines"))).alias("text_md5"),
    )
    texts = F.broadcast(known.select(F.col("digest").alias("text_md5"), F.col("license").alias("text_license")))
    return rows.join(texts, "text_md5", "left").select("doc_id", "text_license", "line_licenses", "text_md5")


def license_sql() -> str:
    """The scan in DuckDB SQL."""

    def canon(text: str) -> str:
        spoken, notice, copyright_line, punctuation = (
            x.replace("\\n", "\n") for x in (SPOKEN_OF, NOTICE_AFTER, COPYRIGHT_LINE, PUNCTUATION))
        out = f"regexp_replace(lower({text}), '{spoken}', 'copy right\\1', 'g')"
        out = f"regexp_replace({out}, '{notice}', '\\1' || chr(10) || '\\2', 'g')"
        out = f"regexp_replace({out}, '{copyright_line}', chr(10), 'g')"
        out = f"replace(regexp_replace({out}, '{punctuation}', ' ', 'g'), chr(10), ' ' || chr(10) || ' ')"
        out = f"' ' || {out} || ' '"
        for variant, spelling in SPELLINGS:
            out = f"replace({out}, ' {variant} ', ' {spelling} ')"
        return out

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(name)}, {quoted(body)})" for name, body in NOTICES + TEXTS)
    flat = "trim(regexp_replace({}, '[ \n]+', ' ', 'g'))"
    return f"""
WITH given(license, body) AS (VALUES {values}),
known AS (SELECT md5({flat.format(canon("body"))}) AS digest, min(license) AS license FROM given GROUP BY 1),
docs AS (SELECT row_number() OVER () AS n, doc_id, {canon("coalesce(text, '')")} AS lines FROM documents),
units AS (SELECT n, unnest(string_split(lines, chr(10))) AS line FROM docs),
hits AS (SELECT n, string_agg(DISTINCT license, ',' ORDER BY license) AS names
         FROM units JOIN known ON md5(trim(line)) = digest GROUP BY n)
SELECT doc_id, license AS text_license, coalesce(names, '') AS line_licenses, md5({flat.format("lines")}) AS text_md5
FROM docs LEFT JOIN known ON md5({flat.format("lines")}) = digest LEFT JOIN hits USING (n)"""
