"""Queries of the line scan: findings over documents and their order, clusters and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.functions import text as T
from sievekit.operators import clusters, lines

#: This library's own rules for prose. Severity ranks: 0 critical, 1 high, 2 medium, 3 low, 4 info.
RULES = [
    {"rule_id": "TXT-CONTACT", "patterns": [r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+"], "not": ["noreply"], "rank": 2},
    {"rule_id": "TXT-ADDRESS", "patterns": [r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"], "not": [r"127\.0\.0\.1"], "rank": 1},
    {"rule_id": "TXT-SECRET", "patterns": [r"(password|token|secret) = .?[A-Za-z0-9]+"], "not": [], "rank": 0},
    {"rule_id": "TXT-LICENSE", "patterns": ["[Ll]icensed? under", "MIT License"], "not": [], "rank": 4},
    {"rule_id": "TXT-NOISE", "patterns": ["[%&*#$]{3}", "!!"], "not": ["@"], "rank": 3},
]
GAP = 5


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.lines_of(documents(spark, sf_dir), "doc_id", "text", "lang", most=T.LINE_CHARS)
    rank = F.create_map(*(x for r in RULES for x in (F.lit(r["rule_id"]), F.lit(r["rank"]))))
    return lines.rule_hits(rows, RULES).withColumn("sev_rank", rank[F.col("rule_id")])


_LINES = """
lines AS (
  SELECT doc_id, lang, line_no, substring(line, 1, 2000) AS line FROM (
    SELECT doc_id, lang, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no
    FROM (SELECT doc_id, lang, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\\x{85}\\x{2028}\\x{2029}]') AS ls FROM documents)))"""
_WHOLE = _LINES.replace("substring(line, 1, 2000) AS line", "line")
_HITS = _LINES + ", findings AS (" + " UNION ALL ".join(
    f"SELECT doc_id, lang, line_no, line, '{r['rule_id']}' AS rule_id, {r['rank']} AS sev_rank FROM lines WHERE ("
    + " OR ".join(f"regexp_matches(line, '{p}')" for p in r["patterns"])
    + ")"
    + "".join(f" AND NOT regexp_matches(line, '{p}')" for p in r["not"])
    + r" AND NOT regexp_matches(line, '#\s*nosec\b|//\s*nosec\b|nosemgrep')"
    for r in RULES
) + ")"


def line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("doc_id", "line_no", "rule_id", "sev_rank", F.sha2("line", 256).alias("line_sha"))


def line_findings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, neighbours within 5 lines merged, in report order."""
    rows = findings(spark, sf_dir).select("doc_id", "rule_id", "sev_rank", F.col("line_no").cast("long").alias("line_no"))
    merged = clusters.gap_clusters(rows, ["doc_id", "rule_id"], "line_no", GAP, [F.col("line_no")])
    return merged.orderBy("sev_rank", "doc_id", "line_no", "rule_id")


_ISLANDS = (
    "WITH "
    + _HITS
    + f""", marked AS (
  SELECT *, CASE WHEN line_no - lag(line_no) OVER w <= {GAP} THEN 0 ELSE 1 END AS fresh FROM findings
  WINDOW w AS (PARTITION BY doc_id, rule_id ORDER BY line_no)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, rule_id ORDER BY line_no) AS island FROM marked)
SELECT doc_id, rule_id, sev_rank, min(line_no) AS line_no, min(line_no) AS cluster_start, max(line_no) AS cluster_end, count(*) AS occurrence_count
FROM islands GROUP BY doc_id, rule_id, sev_rank, island"""
)


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("sev_rank", "lang").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))


def statement_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = lines.statements(lines.lines_of(pages, "page_id", "html"), "page_id")
    return rows.groupBy("page_id", "stmt_id").agg(
        F.min("line_no").cast("long").alias("first_line"), F.max("line_no").cast("long").alias("last_line"), F.max("depth").cast("long").alias("max_depth")
    ).withColumn("stmt_id", F.col("stmt_id").cast("long"))


def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules that leave out some sources, by name and by glob."""
    rows = lines.lines_of(documents(spark, sf_dir), "doc_id", "text", "source", most=T.LINE_CHARS)
    rules = [RULES[1] | {"exclude_paths": ["rc1", "src?"]}, RULES[3] | {"exclude_paths": ["*[02468]"]}]
    return lines.rule_hits(rows, rules, path_col="source").groupBy("source", "rule_id").agg(F.count("*").alias("n"))


def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and lines of each language and source."""
    docs = documents(spark, sf_dir)
    return docs.groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum(F.size(F.split("text", "\n", -1))).alias("lines"))


def rule_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest for all the findings of a document, in their order."""
    rows = findings(spark, sf_dir).select("doc_id", F.struct("line_no", "rule_id").alias("f"))
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("f")).alias("fs"))  # the findings of one document
    return rows.select("doc_id", F.sha2(F.array_join(F.transform("fs", lambda x: F.concat_ws(":", x["line_no"], x["rule_id"])), ","), 256).alias("digest"))


def line_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct identifiers on lines that speak of a licence, without stop words."""
    rows = lines.lines_of(documents(spark, sf_dir), "doc_id", "text").filter(F.col("line").contains("icense"))
    return rows.select("doc_id", "line_no", F.array_join(T.identifiers(F.col("line"), ["the", "under", "is"]), ",").alias("identifiers"))


_DEPTH = " + ".join(f"(length(line) - length(replace(line, '{c}', '')))" for c in "([{") + "".join(f" - (length(line) - length(replace(line, '{c}', '')))" for c in ")]}")
_SPANS = (
    "WITH "
    + _WHOLE.replace("doc_id, lang", "page_id").replace("text,", "html,").replace("documents", "pages")
    + f""",
s AS (SELECT *, sum({_DEPTH}) OVER (PARTITION BY page_id ORDER BY line_no) AS s FROM lines),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY line_no)) AS depth FROM s),
i AS (SELECT *, coalesce(sum(CASE WHEN depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stmt_id FROM d)
SELECT page_id, CAST(stmt_id AS BIGINT) AS stmt_id, min(line_no) AS first_line, max(line_no) AS last_line, CAST(max(depth) AS BIGINT) AS max_depth FROM i GROUP BY 1, 2"""
)

QUERIES = {
    "statement_spans": statement_spans,
    "excluded_paths": excluded_paths,
    "language_histogram": language_histogram,
    "rule_digest": rule_digest,
    "line_identifiers": line_identifiers,
    "line_findings": line_findings,
    "line_findings_report": line_findings_report,
    "severity_counts": severity_counts,
}
ORACLES = {
    "line_findings": "WITH " + _HITS + " SELECT doc_id, line_no, rule_id, sev_rank, sha256(line) AS line_sha FROM findings",
    "line_findings_report": _ISLANDS,
    "severity_counts": "WITH " + _HITS + " SELECT sev_rank, lang, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM findings GROUP BY 1, 2",
    "statement_spans": _SPANS,
    "excluded_paths": "WITH " + _HITS + """
SELECT source, rule_id, count(*) AS n FROM findings JOIN documents USING (doc_id)
WHERE (rule_id = 'TXT-ADDRESS' AND NOT contains(source, 'rc1') AND NOT regexp_full_match(source, 'src.')) OR (rule_id = 'TXT-LICENSE' AND NOT regexp_matches(source, '[02468]$')) GROUP BY 1, 2""",
    "language_histogram": "SELECT lang, source, count(*) AS docs, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY 1, 2",
    "rule_digest": "WITH " + _HITS + " SELECT doc_id, sha256(string_agg(line_no || ':' || rule_id, ',' ORDER BY line_no, rule_id)) AS digest FROM findings GROUP BY doc_id",
    "line_identifiers": "WITH " + _WHOLE + """,
w AS (SELECT doc_id, line_no, regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*') AS ws FROM lines WHERE contains(line, 'icense')),
u AS (SELECT doc_id, line_no, unnest(ws) AS x, unnest(range(len(ws))) AS k FROM w),
d AS (SELECT doc_id, line_no, x, min(k) AS k FROM u WHERE x NOT IN ('the', 'under', 'is') GROUP BY 1, 2, 3)
SELECT w.doc_id, w.line_no, coalesce(string_agg(x, ',' ORDER BY k), '') AS identifiers FROM w LEFT JOIN d USING (doc_id, line_no) GROUP BY 1, 2""",
}
