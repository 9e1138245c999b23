"""Licences by the digest of canonical text, in the engine's own expressions.

Canonical: lines that name a copyright holder go, letters are lower case, spellings that mean the same become
one, everything but letters a-z and digits is one space. The digests of whole texts, and of each line that
speaks of a licence, are joined with a broadcast table of known digests (licence_texts.KNOWN, a few rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.licence_texts import KNOWN

HOLDER = r"^[^a-z0-9(©]*(copyright[^a-z0-9]*(\(c\)|©|[0-9]{4}|<)|\(c\)|©)"
SPEAKS = "licen[cs]e"
#: Fixed values, applied in this order to lower-case text: what is found, what it becomes.
SPELLINGS = [
    ("[^a-z0-9]+", " "),
    ("all rights reserved", " "),
    ("licence", "license"),
    ("([a-z]{3})is(e|ed|es|ing|ation|ations) ", "$1iz$2 "),
    ("([a-z]{2})our(s|ed|able|ite)? ", "$1or$2 "),
    ("copyright owner", "copyright holder"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("per cent ", "percent "),
    ("whilst ", "while "),
    (" +", " "),
]


def canonical(text: Column) -> Column:
    lines = F.filter(F.split(F.lower(text), "\n"), lambda x: ~x.rlike(HOLDER))
    out = F.concat(F.array_join(lines, "\n"), F.lit(" "))
    for found, becomes in SPELLINGS:
        out = F.regexp_replace(out, found, becomes)
    return F.trim(out)


def licence_scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each id: ``text_digest`` (SHA-256 of the canonical whole text), ``license_id`` if that is a known one,
    ``n_notices`` (lines that are a known notice) and ``notices`` (their identifiers, sorted, comma-joined; '' if none).

    Whole texts are read. A null or empty text has the digest of nothing and no licence; so has a text of
    punctuation only. Rows that repeat an id are put together (their lines are summed up, the smallest digest
    stays); rows without an id come as one. Other columns aren't read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(known, "license string, known string").select("license", F.sha2(canonical(F.col("known")), 256).alias("digest"))
    table = F.broadcast(table.groupBy("digest").agg(F.min("license").alias("license")))  # the known texts, a few rows
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike(SPEAKS))
    notices = F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(canonical(x), 256).alias("digest")))
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.sha2(canonical(text), 256).alias("digest")))
    units = docs.select(F.col(id_col).alias("_id"), F.explode(F.concat(whole, notices)).alias("_u")).select("_id", "_u.*")
    found = units.join(table, "digest", "left").groupBy("_id").agg(
        F.min(F.when(F.col("whole"), F.col("digest"))).alias("text_digest"),
        F.min(F.when(F.col("whole"), F.col("license"))).alias("license_id"),
        F.count_if(~F.col("whole") & F.col("license").isNotNull()).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("notices"),
    )
    return found.select(F.col("_id").alias(id_col), "text_digest", "license_id", "n_notices", "notices")


def oracle(known: list[tuple[str, str]] = KNOWN) -> str:
    """The same in SQL for DuckDB."""

    def sql(text: str) -> str:
        out = f"list_aggregate(list_filter(string_split(lower({text}), chr(10)), lambda x: NOT regexp_matches(x, '{HOLDER}')), 'string_agg', chr(10))"
        out = f"coalesce({out}, '') || ' '"
        for found, becomes in SPELLINGS:
            out = f"regexp_replace({out}, '{found}', '{becomes.replace('$', chr(92))}', 'g')"
        return f"sha256(trim({out}, ' '))"

    quoted = lambda x: x.replace("'", "''")
    values = ", ".join(f"('{quoted(a)}', '{quoted(b)}')" for a, b in known)
    return f"""
WITH known AS (SELECT min(license) AS license, digest FROM (SELECT license, {sql("body")} AS digest FROM (VALUES {values}) AS v(license, body)) GROUP BY digest),
units AS (
  SELECT doc_id, true AS whole, {sql("coalesce(text, '')")} AS digest FROM documents
  UNION ALL
  SELECT doc_id, false, {sql("line")} FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(lower(line), '{SPEAKS}'))
SELECT doc_id, min(digest) FILTER (whole) AS text_digest, min(license) FILTER (whole) AS license_id,
  count(*) FILTER (NOT whole AND license IS NOT NULL) AS n_notices,
  coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (NOT whole AND license IS NOT NULL), '') AS notices
FROM units LEFT JOIN known USING (digest) GROUP BY doc_id"""
