"""License scans by canonical digest lookup.

A text is normalised (case, punctuation, copyright lines, equivalent spellings)
and the digest of the whole normalised text is hash-joined with the digests of
known license texts.  Lines are looked up in the same way, so a license
statement inside a longer text is found as well.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The known digests are broadcast up to so many rows; more are joined by shuffle.
BROADCAST_ROWS = 200_000

# Equivalent spellings and what they are read as.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
)

# Public license texts, by their usual short names.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN: tuple[tuple[str, str], ...] = (
    (
        "MIT",
        "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.\n" + _AS_IS,
    ),
    ("ISC", "ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)

#: Whole license texts, one file each, named after the license.
TEXTS = Path(__file__).parent / "license_texts"

#: A whole line that only claims a copyright: the word or sign with a mark, a year or a name behind it, or the reservation of rights.
COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:(?i:copyright)[^\p{L}\p{N}\n]*(?:(?i:\(c\)|\x{A9}|by\b|[0-9]{4}|<year>|\[yyyy\])"
    r"|(?!(?i:and|or|notices?|holders?|owners?|licen[sc]es?|laws?|interests?|statements?|disclaimers?|permissions?|acts?|protection|treaty|rights?|in|to|is|for)\b)\p{Lu})"
    r"|(?i:\(c\))[^\p{L}\p{N}\n]*(?:(?i:copyright)\b|[0-9]{4})|\x{A9}|(?i:all rights reserved)[^\p{L}\p{N}\n]*$)[^\n]*$"
)


def normalise(text: Column) -> Column:
    """Lower case, no copyright lines, words of letters and digits with one space between, one spelling."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, " ")
    # Two blanks between words, so that neighbours share none and each spelling is found.
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for old, new in SPELLINGS:
        wide = lambda x: "  ".join("".join(c if c.isalnum() else " " for c in x).split())
        t = F.replace(t, F.lit(f" {wide(old)} "), F.lit(f" {wide(new)} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text; null where nothing is left."""
    # The empty text's digest is compared, since a condition on the text would normalise it twice.
    return F.nullif(F.sha2(normalise(text), 256), F.sha2(F.lit(""), 256))


def whole_texts() -> list[tuple[str, str]]:
    """(license, text) of KNOWN and of the files, also without the title and without what follows the terms."""
    out = list(KNOWN)
    for name, text in KNOWN:
        title, _, rest = text.partition("\n")
        if title.lower() == f"{name} license".lower():
            out.append((name, rest))
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text("utf-8").strip()
        terms = re.split(r"(?m)(?<=END OF TERMS AND CONDITIONS)\s*$", text)[0]
        for t in {text, terms}:
            head, _, rest = t.partition("\n\n")
            out.append((path.stem, t))
            if len(head) < 250 and "permi" not in head and not re.search(r"(?i)^\s*copyright", head):
                out.append((path.stem, rest))
    return out


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(digest, license, hint) of known texts, by default whole_texts(), one row per digest.

    hint: a word of the normalised text that no spelling rule makes, so that every text of the digest has it; null if there is none.
    """
    made = sorted({w for _, new in SPELLINGS for w in re.findall(r"\w+", new)})
    table = spark.createDataFrame(whole_texts() if known is None else list(known), "license string, text string")
    table = table.select("license", normalise(F.col("text")).alias("n")).filter("n <> ''")
    words = F.filter(F.split("n", " "), lambda w: ~w.isin(made) & w.rlike("^[a-z0-9]+$"))
    hint = F.array_max(F.transform(words, lambda w: F.struct(F.length(w), w.alias("word"))))["word"]
    return table.select(F.sha2("n", 256).alias("digest"), "license", hint.alias("hint")).groupBy("digest").agg(F.min("license").alias("license"), F.min("hint").alias("hint"))


#: Distinct hints up to which lines are narrowed by them; without hints, or beyond, every line is looked up.
MOST_HINTS = 200


def known_hints(known: DataFrame) -> list[str]:
    """Words of which every line with a known digest has one, in lower case; none if all lines must be looked up."""
    if "hint" not in known.columns:
        return []
    hints = [r[0] for r in known.select("hint").distinct().limit(MOST_HINTS + 1).collect()]
    return [] if None in hints or len(hints) > MOST_HINTS else sorted(hints)


def with_hint(line: Column, hints: list[str]) -> Column:
    """Whether the line has one of the words; it is turned to lower case once for all of them."""
    return F.exists(F.array(F.lower(line)), lambda low: reduce(or_, (F.contains(low, F.lit(h)) for h in hints)))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_sha256, license, line_licenses of every row.

    license: that whose whole text the document is, else null; line_licenses:
    those that its lines state, sorted.  Every line is a candidate if its own
    normalised text is a known one.  Null and empty texts have neither; rows
    alike are judged alike; an empty table gives no rows.
    """
    lines = F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n"))
    hints = known_hints(known)
    named = F.filter(lines, lambda x: with_hint(x, hints)) if hints else lines
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), digest(F.col("text")).alias("text_sha256"), named.alias("named"))
    # One row for the text (at = 0), then one per line that may state a license.
    at = F.posexplode_outer(F.concat(F.array(F.lit(None).cast("string")), "named")).alias("at", "line")
    rows = base.select("doc_id", "text_hash", "text_sha256", at)
    rows = rows.withColumn("key", F.when(F.col("at") == 0, F.col("text_sha256")).otherwise(digest(F.col("line"))))
    known = known.select(F.col("digest").alias("k_digest"), "license")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    found = rows.join(known, F.col("key") == F.col("k_digest"), "left").filter((F.col("at") == 0) | F.col("license").isNotNull())
    whole = F.col("at") == 0
    each = found.groupBy("doc_id", "text_hash", "text_sha256").agg(
        F.count(F.when(whole, 1)).alias("copies"), F.max(F.when(whole, F.col("license"))).alias("license"), F.array_sort(F.collect_set(F.when(~whole, F.col("license")))).alias("line_licenses")
    )
    return each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "text_sha256", "license", F.array_join("line_licenses", ",").alias("line_licenses"))


def report(docs: DataFrame) -> DataFrame:
    """scan() with the known texts.

    Null and empty texts have no digest and no license; a long text has one
    digest and as many lines as it has.  Repeated rows have a row each; ties (a
    digest of two licenses) go to the first name.  Extra columns are not read;
    an empty table gives no rows.
    """
    return scan(docs, known_digests(docs.sparkSession))
