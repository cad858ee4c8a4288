"""Licence scan: canonical digests of whole texts and of whole lines, joined to the digests of known licences.

Canonical form: lower case A-Z; lines that hold nothing but a copyright notice go; equivalent spellings become one word;
every run of other characters than a-z and 0-9 becomes one space; ends are trimmed. Its SHA-256 is the digest. Both
sides go through the same expressions, so `known` may hold texts in any layout. Digests are joined by equality; the
known table is broadcast only if it has at most MOST_KNOWN rows, otherwise Spark's shuffled join takes over.

Cases. Null text: as empty; an empty canonical form matches nothing. If several known texts have one canonical form the
smallest name wins. Rows that repeat a doc_id are scanned each by itself. Empty tables: no rows, or no matches. Extra columns are
dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import only

MOST_KNOWN = 100_000

# Equivalent spellings (written -> canonical), after the licence-matching guidelines' kind of list.
SPELLINGS = [
    ("acknowledgment", "acknowledgement"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"),
    ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgment", "judgement"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
]

# Known licence texts and one-line notices (public).
KNOWN = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "notice: Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice: CC-BY-4.0": "Licensed under CC BY 4.0.",
    "notice: CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice: CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "notice: CC0-1.0": "This work is released under CC0 1.0.",
    "notice: GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "notice: GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice: MIT": "Released under the MIT License.",
}

COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright\b|\(c\)\s|©)[^\n]*$"


def _gate() -> str:
    """The spellings as one pattern, branched by first letter, so that most words fail at one character."""
    by_letter: dict[str, list[str]] = {}
    for written, _ in SPELLINGS:
        by_letter.setdefault(written[0], []).append(written[1:])
    return r"\b(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in sorted(by_letter.items())) + r")\b"


def with_form(rows: DataFrame, text: str = "text", name: str = "lines") -> DataFrame:
    """rows with their canonical lines that hold anything. A text's canonical form is its lines joined by a space.

    Each step is a projection of its own: an expression that names the one before twice would work it out twice.
    """
    keep = [c for c in rows.columns if c != name]
    step = lambda df, column: df.select(*keep, column.alias(name))
    x = F.col(name)
    rows = step(rows, F.lower(F.coalesce(F.col(text), F.lit(""))))
    noted = x.contains("copyright") | x.contains("(c)") | x.contains("©")
    rows = step(rows, F.when(noted, F.regexp_replace(x, COPYRIGHT_LINE, "")).otherwise(x))
    rows = step(rows, F.regexp_replace(x, "[^a-z0-9\n]+", " "))
    spelled = x
    for written, one in SPELLINGS:
        spelled = F.regexp_replace(spelled, rf"\b{written}\b", one)
    rows = step(rows, F.when(x.rlike(_gate()), spelled).otherwise(x))
    return step(rows, F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(s)), lambda s: s != ""))


def digest(form: F.Column) -> F.Column:
    return F.when(form != "", F.sha2(form, 256))


def known_licences(spark: SparkSession, known: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """(digest, licence) of known texts: a dict, a DataFrame (licence, text), or the ones above."""
    if not isinstance(known, DataFrame):
        known = spark.createDataFrame(sorted((known or KNOWN).items()), "licence string, text string")
    table = with_form(only(known, licence="string", text="string")).where(F.size("lines") > 0)
    return table.groupBy(F.sha2(F.array_join("lines", " "), 256).alias("digest")).agg(F.min("licence").alias("licence"))


def _bounded(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(MOST_KNOWN + 1).count() <= MOST_KNOWN else table


def scan(docs: DataFrame, known: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """(doc_id, text_digest, licence, line_licences): of the whole text, and of its lines (sorted, distinct).

    One pass over the texts, which are never shuffled: a row becomes digests, of the whole and of each distinct line, that
    are joined together. Of line digests only those with a licence go on.
    """
    table = _bounded(known_licences(docs.sparkSession, known))
    rows = with_form(only(docs, doc_id="long", text="string").withColumn("row", F.monotonically_increasing_id()))
    whole = F.struct(F.lit(True).alias("whole"), digest(F.array_join("lines", " ")).alias("digest"))
    each = F.transform(F.array_distinct("lines"), lambda s: F.struct(F.lit(False).alias("whole"), F.sha2(s, 256).alias("digest")))
    found = rows.select("row", "doc_id", F.inline_outer(F.concat(F.array(whole), each))).join(table, "digest", "left").where("whole OR licence IS NOT NULL")
    return found.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("whole"), F.col("digest"))).alias("text_digest"),
        F.max(F.when(F.col("whole"), F.col("licence"))).alias("licence"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("licence")))), ",").alias("line_licences"),
    ).drop("row")


def _sql_canonical(text: str) -> str:
    form = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', '', 'g')"
    form = f"trim(regexp_replace({form}, '[^a-z0-9]+', ' ', 'g'))"
    for written, one in SPELLINGS:
        form = f"regexp_replace({form}, '\\b{written}\\b', '{one}', 'g')"
    return form


def oracle_sql() -> str:
    """scan(documents) in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted(KNOWN.items()))
    return f"""
WITH known AS (SELECT sha256(form) AS digest, min(licence) AS licence FROM (SELECT licence, {_sql_canonical("text")} AS form FROM (VALUES {values}) v(licence, text)) WHERE form <> '' GROUP BY 1),
whole AS (SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS text_digest FROM (SELECT doc_id, {_sql_canonical("text")} AS form FROM documents)),
lines AS (SELECT DISTINCT doc_id, {_sql_canonical("line")} AS form FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
named AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS line_licences FROM lines JOIN known ON sha256(form) = digest WHERE form <> '' GROUP BY doc_id)
SELECT w.doc_id, w.text_digest, k.licence, coalesce(n.line_licences, '') AS line_licences
FROM whole w LEFT JOIN known k ON w.text_digest = k.digest LEFT JOIN named n ON w.doc_id = n.doc_id"""
