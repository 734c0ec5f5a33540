"""Licence scan by canonical digest lookup.

A text is brought into a canonical form (lower case, copyright lines deleted, punctuation to blanks, equivalent spellings
made one, white space collapsed) and hashed; a hash join with the digests of known licences identifies it. Each of its
paragraphs and lines goes through the same join, because notices often stand alone there. No word decides beforehand what is
looked up.

Defined results: null and empty texts have the digest of the empty string and no licence; repeated rows each get their own
result row; a null doc_id stays null; an empty table gives no rows. Very long texts are read whole. Extra columns are ignored
whatever their names. Of licences with one digest the first name counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .license_digests import FULL

#: Texts of well-known licences and notices, by SPDX name.
KNOWN = {
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "Released under the MIT License.",
        "Licensed under the MIT License.",
    ],
    "ISC": ['Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.', "Licensed under the ISC License."],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed under the Apache License, Version 2.0.",
    ],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."],
    "GPL-2.0-only": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Licensed under CC0 1.0."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
#: Spellings that count as one, the first becoming the second.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("copyright owner", "copyright holder"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("honour", "honor"), ("fulfil", "fulfill"), ("https", "http")]


def _steps() -> list[tuple[str, str]]:
    """(pattern, replacement) in order; all are common to Java's regex and RE2."""
    steps = [("(?im)^[^a-z0-9\n]*(copyright|©|\\(c\\))[^\n]*$", ""), ("[^0-9A-Za-z\u0080-\U0010ffff]+", " ")]
    return steps


def canonical(text):
    """The canonical form of a text column."""
    out = F.coalesce(text, F.lit(""))
    for pattern, to in _steps():
        out = F.regexp_replace(out, pattern.replace("\U0010ffff", "\\x{10ffff}").replace("\u0080", "\\x{80}"), to)
    out = F.translate(F.concat(F.lit(" "), F.trim(out), F.lit(" ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def canonical_sql(text: str) -> str:
    out = f"coalesce({text}, '')"
    for pattern, to in _steps():
        pattern = pattern.replace("\U0010ffff", "\\x{10ffff}").replace("\u0080", "\\x{80}").replace("\n", "\\n")
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    out = f"translate(' ' || trim({out}) || ' ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim({out})"


def known(spark) -> DataFrame:
    """digest, license: a fixed table of some hundred rows, so its broadcast is bounded."""
    rows = [(name, text) for name, texts in KNOWN.items() for text in texts]
    short = spark.createDataFrame(rows, "license string, text string").select(F.md5(canonical(F.col("text"))).alias("digest"), "license")
    full = spark.createDataFrame([(digest, name) for name, digests in FULL.items() for digest in digests], "digest string, license string")
    return short.unionByName(full).groupBy("digest").agg(F.min("license").alias("license"))


#: What parts paragraphs: blank lines.
GAP = "\n[ \t\r]*\n"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_digest, license (of the whole text, or null), notices (licences of its paragraphs and lines, sorted, comma-joined).

    One pass over the texts: digests of the whole, the paragraphs and the lines meet the table; only the whole's row and
    hits go on."""
    text = F.coalesce("text", F.lit(""))
    digest = lambda x: F.md5(canonical(x))
    parts = F.array_distinct(F.transform(F.concat(F.split(text, GAP), F.split(text, "\n")), digest))
    looked = F.concat(F.array(F.struct(F.lit(True).alias("whole"), digest(text).alias("digest"))), F.transform(parts, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("digest"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))  # before the parts: one number a row
    rows = rows.select("doc_id", "row", F.explode(looked).alias("x")).select("doc_id", "row", "x.whole", "x.digest")
    found = rows.join(F.broadcast(known(docs.sparkSession)), "digest", "left").where("whole or license is not null")  # a fixed table
    found = materialize(found, "license-hits")
    notices = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",")
    out = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max(F.when(F.col("whole"), F.col("digest"))).alias("text_digest"), F.max(F.when(F.col("whole"), F.col("license"))).alias("license"), notices.alias("notices"))
    return out.select("doc_id", "text_digest", "license", "notices")


def scan_sql() -> str:
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, texts in KNOWN.items() for text in texts)
    full = ", ".join(f"('{name}', '{digest}')" for name, digests in FULL.items() for digest in digests)
    return f"""
WITH known AS (SELECT digest, min(name) AS name FROM (SELECT name, md5({canonical_sql("t")}) AS digest FROM (VALUES {values}) AS v(name, t) UNION ALL SELECT name, digest FROM (VALUES {full}) AS w(name, digest)) GROUP BY digest),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT r, unnest(list_distinct(list_concat(string_split_regex(text, '\n[ \t\r]*\n'), string_split(text, chr(10))))) AS part FROM d),
hit AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS s FROM parts JOIN known ON md5({canonical_sql("part")}) = known.digest GROUP BY r)
SELECT d.doc_id, d.text_digest, known.name AS license, coalesce(hit.s, '') AS notices
FROM (SELECT r, doc_id, md5({canonical_sql("text")}) AS text_digest FROM d) d LEFT JOIN known ON d.text_digest = known.digest LEFT JOIN hit ON d.r = hit.r"""
