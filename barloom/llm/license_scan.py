"""License texts by canonical digest.

A text is brought to a canonical form (case, punctuation, copyright lines and equivalent spellings removed), digested, and
the digest looked up in a table of known licences by a hash join. Two kinds of units are looked up: whole documents, and each of
their lines, so that both a document that is a licence text and a notice inside other text are found. All in
Spark's own functions; the known table has one row per licence form and is broadcast (its size is fixed by LICENSES).

Defined cases: a NULL or empty text has no licence; a line repeated in a document counts each time; a NULL doc_id is
kept, repeated rows are scanned one by one; an empty table gives an empty result; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known texts (public licence texts and common notices), by licence id; compared in canonical form.
LICENSES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    (
        "MIT",
        "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:\nThe above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS '
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)

#: Spellings taken for the same, in this order, after lower-casing.
SPELLINGS = (
    ("https", "http"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("copyright holder", "copyright owner"),
    ("per cent", "percent"),
    ("&", "and"),
    ("version ", "v"),
)
COPYRIGHT_LINE = r"(^|\n)[^\na-z0-9]*(copyright( \(c\)| ©)? [0-9]|\(c\) [0-9]|© ?[0-9]|copyright \(c\)|all rights reserved)[^\n]*"
NOT_LETTERS = "[^a-z0-9]+"
SPACES = r"[\x20\x09-\x0D]+"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, with one spelling, letters and digits parted by single spaces."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n"), SPACES, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, NOT_LETTERS, " "))


def digest(text: Column) -> Column:
    return F.md5(canonical(text))


def known_table(spark: SparkSession, licenses: tuple[tuple[str, str], ...] = LICENSES) -> DataFrame:
    """digest, license: one row per known canonical form."""
    rows = spark.createDataFrame(list(licenses), "license string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A row for each match: doc_id, line (0: the document as a whole, else its number from 1), license, digest.

    Every unit is digested and the hash join alone decides. Nothing is shuffled: the known table is the broadcast side.
    """
    found = F.broadcast(known_table(docs.sparkSession) if known is None else known)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("unit")))
    units = F.concat(F.array(F.struct(F.lit(0).alias("line"), F.col("text").alias("unit"))), lines)
    units = rows.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.line", digest(F.col("u.unit")).alias("digest"))
    return units.join(found, "digest").select("doc_id", "line", "license", "digest")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(documents: str = "documents", licenses: tuple[tuple[str, str], ...] = LICENSES) -> str:
    """The same scan for DuckDB, over every line (no word is looked for first)."""

    def form(x: str) -> str:
        x = f"regexp_replace(lower({x}), {_quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
        x = f"regexp_replace({x}, {_quoted(SPACES)}, ' ', 'g')"
        for old, new in SPELLINGS:
            x = f"replace({x}, {_quoted(old)}, {_quoted(new)})"
        return f"md5(trim(regexp_replace({x}, {_quoted(NOT_LETTERS)}, ' ', 'g'), ' '))"

    rows = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licenses)
    return f"""
WITH known AS (SELECT {form("text")} AS digest, min(license) AS license FROM (VALUES {rows}) v(license, text) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM {documents}),
l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d),
u AS (SELECT doc_id, 0 AS line, text AS unit FROM d
  UNION ALL SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS unit FROM l)
SELECT doc_id, CAST(line AS INTEGER) AS line, license, u2.digest FROM (SELECT doc_id, line, {form("unit")} AS digest FROM u) u2
JOIN known ON known.digest = u2.digest
"""
