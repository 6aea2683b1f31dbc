"""Licence scan: canonical texts looked up by digest, JVM side only.

A text is brought to a canonical form: A to Z and all other letters lower-case, statements
of a copyright that open a line (STATEMENT) dropped, punctuation and layout reduced to single
spaces, equivalent spellings made one. The digest of an entire canonical text is then joined
with the digests of known licences. Entire texts are whole documents and single lines, so both a licence file
and a licence notice on a line of its own are found, never a mere mention inside a line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_key, prepare, text_sha

#: Spellings that licence texts use for the same word.
EQUIVALENT = (
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"),
    ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with
or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution.
"""

_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written
permission.
"""

_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER
IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License
is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the
License."""

_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of
the GNU General Public License as published by the Free Software Foundation, either version {} of
the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not,
see <{}://www.gnu.org/licenses/>."""

_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a
copy of the MPL was not distributed with this file, You can obtain one at
{}://mozilla.org/MPL/2.0/."""

_CC = "This work is licensed under the Creative Commons {} 4.0 International License."

_CC0 = """To the extent possible under law, the person who associated CC0 with this work has waived
all copyright and related or neighboring rights to this work."""

#: Fixed values: (licence id, text, header or notice). Callers may pass a list of their own.
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC), ("ISC", "Licensed under the ISC License."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", _APACHE), ("Apache-2.0", _APACHE.replace("http:", "https:")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", _GPL.format(3, "https")), ("GPL-3.0", _GPL.format(3, "http")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", _GPL.format(2, "https")), ("GPL-2.0", _GPL.format(2, "http")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", _BSD_START + _BSD_NAME + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_START + _BSD_NAME + _BSD_END),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_START + _BSD_END),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", _MPL.format("https")), ("MPL-2.0", _MPL.format("http")),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", _CC.format("Attribution")), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", _CC.format("Attribution-ShareAlike")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", _CC.format("Attribution-NonCommercial")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC0-1.0", _CC0), ("CC0-1.0", "Released under CC0 1.0."),
)

_YEAR = r"(?:[0-9]{4}|[<\[{(](?:year|yyyy)s?[>\]})])"
_EMAIL = r"[^ \t\n@]+@[^ \t\n@]+"
#: Words that open the sentence after a statement; from there on the line is text.
_NEXT = (r"(?:licensed|released|distributed|redistribution|permission|spdx|mit license|isc license|"
         r"(?:the|this) (?:software|work|project|program|file|library|source|code))")
_AFTER = rf"[.;,]+[ \t]+({_NEXT}[^\n]*)"
#: A copyright statement, in both SQL dialects: a line that opens with 'copyright' and holds a
#: year, a mark or an address, that opens with '(c)' and a year, or with the sign, up to the
#: next sentence or the line end; or 'all rights reserved' alone. Any other line is text.
STATEMENT = (
    r"^[^\p{L}\p{N}\n(©]*(?:"
    rf"(?:copyright[^\n]*?(?:{_YEAR}|\(c\)|©|{_EMAIL})|\(c\)[ \t,:]*(?:copyright[ \t,:]*)?{_YEAR}|©)"
    rf"[^\n]*?(?:{_AFTER})?|all rights reserved(?:{_AFTER}|[^\p{{L}}\p{{N}}\n]*))$")
#: One of these is in every line that STATEMENT matches.
MARKS = ("copyright", "(c)", "©", "all rights reserved")
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Canonical form of a text; its words are separated by single spaces."""
    low = F.lower(text)
    marked = reduce(Column.__or__, [F.contains(low, F.lit(m)) for m in MARKS])
    # (?d): only a line feed ends a line, as in the other dialect
    text = F.when(marked, F.regexp_replace(low, "(?md)" + STATEMENT, "$1$2")).otherwise(low)
    text = F.trim(F.regexp_replace(text, NOT_WORD, " "))
    for other, one in EQUIVALENT:
        text = F.replace(text, F.lit(other), F.lit(one))
    return text


def canonical_sql(text: str) -> str:
    """The same in DuckDB."""
    text = f"regexp_replace(lower({text}), '(?m){STATEMENT}', '\\1\\2', 'g')"
    text = f"trim(regexp_replace({text}, '{NOT_WORD}', ' ', 'g'))"
    for other, one in EQUIVALENT:
        text = f"replace({text}, '{other}', '{one}')"
    return text


def needles(canonical_texts: list[str]) -> list[str]:
    """Strings of which a lower-case text must hold one to be one of the known texts.

    For each known text its longest word, in every spelling that becomes that word. Words that
    an equivalence of several words may have made are left out.
    """
    several = [one for other, one in EQUIVALENT if " " in other or " " in one]
    made = {word for one in several for word in one.split()}
    found: set[str] = set()
    for text in canonical_texts:
        words = [w for w in text.split() if not any(m in w for m in made)]
        if not words:
            return [""]
        word = max(words, key=lambda w: (len(w), w))
        spellings = {word}
        for other, one in EQUIVALENT:
            if " " not in other + one:
                spellings |= {w.replace(one, other) for w in spellings}
        found |= spellings
    return sorted(found)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark, known=KNOWN) -> DataFrame:
    """(digest, license_id, text): the least id where two licences have the same canonical text."""
    rows = spark.createDataFrame(list(known), "license_id string, text string")
    return rows.groupBy(canonical(F.col("text")).alias("text")).agg(
        F.min("license_id").alias("license_id")).withColumn(
        "digest", F.sha2(F.col("text").cast("binary"), 256))


def scan_licenses(docs: DataFrame, known=KNOWN) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_license, line_licenses, n_license_lines.

    ``text_license`` is the licence that the whole text is, ``line_licenses`` the distinct
    licences of single lines, sorted and joined by commas, both null if there is none. A text
    without words matches nothing. Null text is empty; repeated rows give repeated rows; an
    empty table gives an empty result; further columns are ignored. Very long texts and lines
    are normalised whole. Only texts and lines that hold a word that every known text of some
    licence holds are normalised at all: no other can match. The known digests, at most as many
    as ``known`` lists, are broadcast; of the lines only matches move.
    """
    spark = prepare(docs.sparkSession)
    texts = known_digests(spark, known)
    words = needles([r.text for r in texts.select("text").collect()])
    digests = F.broadcast(texts.drop("text"))

    def possible(text: str) -> Column:
        low = F.lower(text)
        return reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lines = rows.select(id_key(), text_sha().alias("sha_key"),
                        F.posexplode(F.split("text", "\n")).alias("place", "line"))
    # A repeated row finds the same lines; its key counts each place once.
    found = (lines.filter(possible("line"))
             .select("id_key", "sha_key", "place", digest(F.col("line")).alias("digest"))
             .join(digests, "digest").groupBy("id_key", "sha_key").agg(
                 F.sort_array(F.collect_set("license_id")).alias("names"),
                 F.count_distinct("place").alias("n_lines")))
    whole = rows.select("doc_id", id_key(), text_sha().alias("sha_key"),
                        F.when(possible("text"), digest(F.col("text"))).alias("digest")
                        ).join(digests, "digest", "left")
    return whole.join(found, ["id_key", "sha_key"], "left").select(
        "doc_id", F.col("license_id").alias("text_license"),
        F.array_join("names", ",").alias("line_licenses"),
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_license_lines"))


def oracle() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"

    values = ", ".join(f"('{name}', {quoted(text)})" for name, text in KNOWN)
    return f"""
WITH known AS (SELECT sha256({canonical_sql('t')}) AS digest, min(license_id) AS license_id
  FROM (VALUES {values}) AS v(license_id, t) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
found AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS names,
  count(*) AS n FROM lines JOIN known ON sha256({canonical_sql('line')}) = digest GROUP BY doc_id)
SELECT d.doc_id, k.license_id AS text_license, f.names AS line_licenses,
  coalesce(f.n, 0) AS n_license_lines
FROM documents d LEFT JOIN known k ON sha256({canonical_sql("coalesce(text, '')")}) = k.digest
LEFT JOIN found f ON f.doc_id = d.doc_id"""
