"""Licence scans by canonical digest lookup.

A text is brought to a canonical form: lower case, copyright lines dropped,
equivalent spellings made one, punctuation and white space reduced to single
spaces. Its digest is joined with the digests of known licence texts, which went
through the same expressions. A document is looked up as a whole and line by line,
each an entire text, so a licence file is found as such and a notice inside prose as
a line of its own.

DataFrame functions only.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Typographic signs and what stands for them in plain text; spellings that licence texts use for the same word. The
#: first becomes the second. Fixed values.
EQUIVALENT = (*zip("\u201c\u201d\u201e\u00ab\u00bb\u2018\u2019\u201a", "\"\"\"\"\"''''"), *zip("\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "-------"),
              *zip("\u2026\u2022\u00b7\u00a0\u2009\u202f\u3000\u2028\ufeff", ".**      "),
              ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
              ("non-infringement", "noninfringement"), ("merchantibility", "merchantability"),
              ("copyright owner", "copyright holder"), ("favour", "favor"), ("organisation", "organization"),
              ("per cent", "percent"), ("https://", "http://"), ("whilst", "while"), ("wilful", "willful"))

#: Notices that stand on a line of their own. Fixed values.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
)
#: Titles that stand above a licence or do not.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License",
                     "Modified BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}


def entire_texts() -> list[tuple[str, str]]:
    """(license, text) of the files in ``license_texts``, with and without what some copies leave out or write otherwise."""
    found = []
    for file in sorted(resources.files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        name, text = file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")
        bodies = [text]
        if name.startswith("BSD-"):
            bodies.append(re.sub(r"(?m)^\s*[0-9]\. ", "* ", text))
            bodies += [b.replace("HOLDERS AND", "HOLDER AND").replace("HOLDER OR", "HOLDERS OR") for b in bodies]
            bodies += [b.replace("HOLDERS OR", "OWNER OR").replace("HOLDER OR", "OWNER OR") for b in bodies]
        if name == "ISC":
            bodies.append(text.replace("and/or distribute", "and distribute"))
        if name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1"):  # without the advice on how to apply it
            bodies.append(re.split(r"(?<=END OF TERMS AND CONDITIONS)", text)[0])
        if name == "Apache-2.0":
            bodies.append(re.split(r"\n\s*END OF TERMS AND CONDITIONS", text)[0])
        found += [(name, f"{title}\n\n{body}") for body in bodies for title in ("", *TITLES.get(name, ()))]
    return found


#: Known texts: the notices and entire licences that are looked up unless others are given.
KNOWN = (*NOTICES, *entire_texts())


def followers(phrase: str) -> set[str]:
    """Words that follow ``phrase`` in the known texts."""
    return {w for _, text in KNOWN for w in re.findall(re.escape(phrase) + r"\s+([a-z]+)", re.sub(r"\s+", " ", text.lower()))}


def other_than(words: set[str], within: bool = False) -> str:
    """Pattern of the start of a word that is none of ``words``, without look-ahead, which DuckDB does not have."""
    rest: dict[str, set[str]] = {}
    for w in words - {""}:
        rest.setdefault(w[0], set()).add(w[1:])
    ways = [rf"[^\x00-\x60\x7B-\x7F{''.join(sorted(rest))}]"]
    if within and "" not in words:
        ways.append(r"([\x00-\x60\x7B-\x7F]|$)")
    return "(" + "|".join(ways + [c + other_than(r, True) for c, r in sorted(rest.items())]) + ")"


#: Lines that name who holds the rights, and are not part of a licence, behind comment signs too. A line of the licence that
#: happens to be broken before the word goes on as one of the known texts does, and stays.
COPYRIGHT_LINE = (r"^[\s\x{A0}\x{FEFF}#/*;%!<>|-]*(copyright:?[\s\x{A0}]+(\(c\)|©|[0-9\[<{]|by\s|the\s+" + other_than(followers("copyright the"))
                  + "|" + other_than(followers("copyright")) + r")|copyright©|\(c\)[\s\x{A0}]*([0-9©]|copyright\s|"
                  + other_than(followers("(c)")) + r")|©|all rights reserved)")


def canonical_line(line: Column) -> Column:
    """Canonical form of one line; '' if nothing of it counts."""
    line = ascii_lower(line)
    line = F.when(line.rlike(COPYRIGHT_LINE), "").otherwise(line)
    signs = [(a, b) for a, b in EQUIVALENT if len(a) == 1]
    line = F.translate(line, "".join(a for a, _ in signs), "".join(b for _, b in signs))
    for spelling, usual in EQUIVALENT[len(signs):]:
        line = F.replace(line, F.lit(spelling), F.lit(usual))
    return F.trim(F.regexp_replace(line, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))


def canonical_lines(text: Column) -> Column:
    """Canonical forms of a text's lines, without those that come out empty."""
    return F.filter(F.transform(F.split(text, "\n", -1), canonical_line), lambda x: x != "")


def digest(canonical: Column) -> Column:
    return F.unhex(F.md5(canonical.cast("binary")))


def known_licenses(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license) of each known text; the smallest name if several share a digest."""
    texts = spark.createDataFrame(list(known), "license string, text string")
    texts = texts.select("license", F.array_join(canonical_lines(F.col("text")), " ").alias("canonical"))
    return texts.where("canonical <> ''").groupBy(digest(F.col("canonical")).alias("digest")).agg(
        F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, license (the whole text is that licence, else null), notices
    (licences of single lines, different ones, sorted, joined by commas; '' if none) and n_notices
    (lines that are a notice, repeats counted).

    Null and empty texts, and texts of copyright lines and punctuation alone, are no licence. Repeated rows give
    repeated results; other columns are not read. An empty table, or an empty ``known``, finds nothing.
    """
    # Lines first: the whole text is its lines, joined. Rows are told apart by a number that stays, as it is cut.
    rows = docs.select(F.col(doc_id).alias("doc_id"), canonical_lines(F.col(text)).alias("lines"))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                           F.when(F.size("lines") > 0, digest(F.array_join("lines", " "))).alias("digest"),
                           F.transform("lines", digest).alias("lines")))
    lines = rows.select("row", F.explode("lines").alias("digest")).join(known, "digest").groupBy("row").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.count(F.lit(1)).alias("n_notices"))
    return rows.drop("lines").join(known, "digest", "left").join(lines, "row", "left").select(
        "doc_id", "license", F.coalesce("notices", F.lit("")).alias("notices"),
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"))


def op9_licenses(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Licences of every document, as a whole and by line."""
    return scan(docs, known_licenses(spark))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    """The same in DuckDB."""
    lower = "translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    line = f"CASE WHEN regexp_matches({lower}, '{COPYRIGHT_LINE}') THEN '' ELSE {lower} END"
    for spelling, usual in EQUIVALENT:
        line = f"replace({line}, {_sql_text(spelling)}, {_sql_text(usual)})"
    line = f"trim(regexp_replace({line}, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', ' ', 'g'))"
    lines = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {line}), lambda x: x <> '')"
    values = ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in KNOWN)
    return f"""
WITH texts(license, text) AS (VALUES {values}),
known AS (SELECT md5(array_to_string({lines}, ' ')) AS digest, min(license) AS license FROM texts GROUP BY 1),
docs AS (SELECT row_number() OVER () AS nth, doc_id, {lines} AS lines FROM documents),
found AS (
    SELECT nth, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices
    FROM (SELECT nth, unnest(lines) AS line FROM docs) JOIN known ON digest = md5(line) GROUP BY nth)
SELECT doc_id, license, coalesce(notices, '') AS notices, coalesce(n_notices, 0)::BIGINT AS n_notices
FROM docs LEFT JOIN known ON len(lines) > 0 AND digest = md5(array_to_string(lines, ' '))
          LEFT JOIN found USING (nth)
"""
