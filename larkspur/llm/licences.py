"""Operator 5: licence scan by canonical digest lookup.

A text is brought into a canonical form (lower case; lines of copyright claims
dropped; punctuation and white space one space; equivalent spellings made one)
and its digest is joined to those of the known licence texts. The whole text of
every document is looked up, and so is every line, which finds notices inside
documents. The table of digests is broadcast: its size is checked against
MAX_KNOWN. No text is shuffled; what is shuffled are ids, and the few lines that
were found.

Defined results: a null text counts as empty and has no licence; a null id
keeps its row; the lines of rows that share an id count together; several
identifiers of one digest aren't possible in the table (checked), several found
in a document are listed in order, with commas; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_texts import KNOWN
from .shared import texts_of

#: Known texts that are broadcast at most; digests and names take about 100 bytes each.
MAX_KNOWN = 100_000
#: A line of a copyright claim with what marks comments before it.
CLAIM = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
SEPARATOR = "[\\x00-/:-@\\[-`{-\\x7f©«»“”‘’–—…]+"
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("organisation", "organization"), ("whilst", "while"),
    ("https", "http"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
]
#: A known text holds one of these, so lines without them can't be one.
STEMS = ("licen", "permi")


def canonical(text: Column) -> Column:
    s = F.regexp_replace(F.lower(text), CLAIM, "\n")
    s = F.concat(F.lit(" "), F.regexp_replace(s, SEPARATOR, " "), F.lit(" "))
    for other, form in SPELLINGS:
        s = F.replace(s, F.lit(f" {other} "), F.lit(f" {form} "))
    return F.trim(s)


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    if len(known) > MAX_KNOWN:
        raise ValueError(f"{len(known)} known texts; at most {MAX_KNOWN} are broadcast")
    if any(not any(s in text.lower() for s in STEMS) for _, text in known):
        raise ValueError(f"a known text without any of {STEMS} would not be found in lines")
    rows = spark.createDataFrame(known, "licence string, text string")
    return rows.select("licence", F.sha2(canonical(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, canonical_sha256, licence (of the whole text) and line_licences."""
    texts = texts_of(docs, id_col, text_col)
    table = F.broadcast(known_digests(docs.sparkSession, known))
    whole = texts.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    whole = whole.join(table, "digest", "left").select("doc_id", F.col("digest").alias("canonical_sha256"), "licence")
    hint = F.lit(False)
    for stem in STEMS:
        hint = hint | F.lower("text").contains(stem)
    lines = texts.where(hint).select("doc_id", F.explode(F.split("text", "\n")).alias("text")).where(hint)
    found = lines.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).join(table, "digest")
    found = found.groupBy(F.col("doc_id").alias("id")).agg(F.concat_ws(",", F.array_sort(F.collect_set("licence"))).alias("line_licences"))
    return whole.join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left").drop("id")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_canonical(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    s = f"regexp_replace(lower({text}), {quote(CLAIM)}, chr(10), 'g')"
    s = f"' ' || regexp_replace({s}, {quote(SEPARATOR)}, ' ', 'g') || ' '"
    for other, form in SPELLINGS:
        s = f"replace({s}, ' {other} ', ' {form} ')"
    return f"trim({s}, ' ')"


def oracle() -> str:
    known = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    return f"""
    WITH known AS (SELECT sha256({_sql_canonical("text")}) AS digest, min(licence) AS licence FROM (VALUES {known}) v(licence, text) GROUP BY 1),
    texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    whole AS (SELECT doc_id, sha256({_sql_canonical("text")}) AS digest FROM texts),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM texts),
    found AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS line_licences
              FROM (SELECT doc_id, sha256({_sql_canonical("text")}) AS digest FROM lines) JOIN known USING (digest) GROUP BY doc_id)
    SELECT w.doc_id, w.digest AS canonical_sha256, k.licence, f.line_licences
    FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN found f ON w.doc_id IS NOT DISTINCT FROM f.doc_id"""
