"""Queries of what reports are made of: components, statements on exploitability, result rows, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.functions import unicode
from sievekit.operators import reports
from sievekit.plans.findings import _SCORED, scored
from sievekit.plans.graphs import read

ECOSYSTEMS = ["PyPI", "npm", "Go", "Maven", "crates.io", "RubyGems", "NuGet", "Packagist", "other"]


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    ecosystem = F.element_at(F.array(*map(F.lit, ECOSYSTEMS)), (F.col("p_size") % len(ECOSYSTEMS) + 1).cast("int"))
    name = F.concat(F.when(F.col("p_size") % 4 == 0, "@s/").otherwise(""), F.regexp_replace("p_name", " ", ":"))
    return parts.select("p_partkey", ecosystem.alias("ecosystem"), name.alias("name"), F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("1."), (F.col("p_size") % 3).cast("string"))).alias("version"))


def bill_of_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as components; equal ones get numbered references."""
    return reports.bill_of_materials(_components(spark, sf_dir).drop("p_partkey")).select("bom_ref", "purl", "ecosystem")


def exploitability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements for parts and the advisories that their number names."""
    reach = F.element_at(F.array(F.lit("reachable"), F.lit("unreachable"), F.lit("unknown")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = _components(spark, sf_dir).withColumns({"advisory_id": F.concat(F.lit("ADV-"), (F.col("p_partkey") % 100).cast("string")), "reachability": reach})
    return reports.exploitability(rows)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("rule_id", "sev_rank", F.col("path").cast("string").alias("path"), (F.col("line") - 1).alias("line"))
    none = F.lit(None).cast("array<struct<path:string,line:bigint,snippet:string>>")
    return rows.withColumns({"message": F.concat(F.lit('found "'), "rule_id", F.lit('"')), "flow": none})


def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as result objects."""
    return reports.sarif_results(_messages(spark, sf_dir))


def json_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.json_findings(_messages(spark, sf_dir).select("rule_id", "sev_rank", "path", "line", "message"))


def exit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of which one pass per nation is known; some haven't completed."""
    passes = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 3, "skipped").otherwise("completed").alias("status"))
    return reports.exit_status(scored(spark, sf_dir), passes, True)


def smuggled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose words only hold a phrase when hidden characters are read: tags stand for the letters of their source."""
    docs = read(spark, sf_dir, "documents")
    hidden = F.concat(F.col("text"), F.lit("\u200big\U000e006e\U000e006fre\u2060 this "), F.when(F.col("doc_id") % 3 == 0, "ignore this").otherwise(F.lit("\u00adend")))
    rows = docs.withColumn("t", F.when(F.col("lang") != "en", hidden).otherwise(F.col("text")))
    return rows.select("doc_id", unicode.smuggled(F.col("t"), "ignore this").alias("smuggled"), F.sha2(unicode.visible(F.col("t")), 256).alias("visible_sha"))


QUERIES = {f.__name__: f for f in (bill_of_materials, exploitability, sarif_results, json_findings, exit_status, smuggled_documents)}
_KIND = "CASE ecosystem WHEN 'PyPI' THEN 'pypi' WHEN 'npm' THEN 'npm' WHEN 'Go' THEN 'golang' WHEN 'Maven' THEN 'maven' WHEN 'crates.io' THEN 'cargo' WHEN 'RubyGems' THEN 'gem' WHEN 'NuGet' THEN 'nuget' WHEN 'Packagist' THEN 'composer' ELSE 'generic' END"
_COMPONENTS = f"""
WITH c AS (SELECT p_partkey, [{", ".join(f"'{e}'" for e in ECOSYSTEMS)}][p_size % 9 + 1] AS ecosystem, CASE WHEN p_size % 4 = 0 THEN '@s/' ELSE '' END || replace(p_name, ' ', ':') AS name,
  CASE WHEN p_size % 5 > 0 THEN '1.' || (p_size % 3) END AS version FROM part),
u AS (SELECT *, 'pkg:' || {_KIND} || '/' || CASE WHEN ecosystem = 'Maven' THEN replace(name, ':', '/') ELSE replace(name, '@', '%40') END || coalesce('@' || version, '') AS purl FROM c)"""
_ROWS = "WITH " + _SCORED + ", m AS (SELECT rule_id, sev_rank, CAST(path AS VARCHAR) AS path, line - 1 AS line, 'found \"' || rule_id || '\"' AS message FROM f)"
ORACLES = {
    "bill_of_materials": _COMPONENTS + """,
n AS (SELECT *, row_number() OVER (PARTITION BY purl ORDER BY ecosystem, name, version NULLS FIRST) AS n FROM u)
SELECT CASE WHEN n = 1 THEN purl ELSE purl || '#' || n END AS bom_ref, purl, ecosystem FROM n""",
    "exploitability": _COMPONENTS + """,
s AS (SELECT DISTINCT 'ADV-' || (p_partkey % 100) AS advisory_id, purl AS product, CASE p_partkey % 3 WHEN 0 THEN 'affected' WHEN 1 THEN 'not_affected' ELSE 'under_investigation' END AS status FROM u)
SELECT *, sha256(concat_ws('|', advisory_id, product, status)) AS id FROM s""",
    "sarif_results": _ROWS + """
SELECT CAST(to_json({'ruleId': rule_id, 'level': ['error', 'error', 'warning', 'note', 'note'][sev_rank + 1], 'message': {'text': message},
  'locations': [{'physicalLocation': {'artifactLocation': {'uri': path}, 'region': {'startLine': greatest(line, 1)}}}]}) AS VARCHAR) AS value FROM m""",
    "json_findings": _ROWS + """
SELECT CAST(to_json({'severity': ['critical', 'high', 'medium', 'low', 'info'][sev_rank + 1], 'rule_id': rule_id, 'sev_rank': sev_rank, 'path': path, 'line': line, 'message': message}) AS VARCHAR) AS value FROM m""",
    "exit_status": "SELECT CASE WHEN bool_or(n_regionkey > 3) THEN 2 WHEN (SELECT count(*) FROM lineitem) > 0 THEN 1 ELSE 0 END AS status, bool_or(n_regionkey > 3) AS degraded FROM nation",
    "smuggled_documents": r"""
SELECT doc_id, lang <> 'en' AND doc_id % 3 <> 0 AND NOT contains(text, 'ignore this') AS smuggled,
  sha256(regexp_replace(CASE WHEN lang <> 'en' THEN text || 'igre this ' || CASE WHEN doc_id % 3 = 0 THEN 'ignore this' ELSE 'end' END ELSE text END,
    '[\x{00AD}\x{061C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]', '', 'g')) AS visible_sha FROM documents""",
}
