"""Queries that choose among findings: order lines, events and documents stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.operators import selection
from sievekit.plans.findings import _SCORED, scored
from sievekit.plans.graphs import read

#: Tokens that together make a chain, of this library's own.
TEMPLATES = {"leak": ["password", "token", "secret", "akia"], "contact": ["@", "+1", "+49"], "terms": ["licensed", "copyright", "warranty"], "none": ["zzzz", "qqqq"]}


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    engine = F.when(F.col("q") % 11 == 0, "depguard").when(F.col("q") % 13 == 0, "crossfile").otherwise(F.col("engine"))
    return rows.withColumns({"engine": engine, "reachability": F.when(F.col("q") > 47, "reachable"), "is_ai": F.col("category") == "config"})


_RANKED = "WITH " + _SCORED + """,
r AS (SELECT * REPLACE (CASE WHEN q % 11 = 0 THEN 'depguard' WHEN q % 13 = 0 THEN 'crossfile' ELSE engine END AS engine), q > 47 AS reachable, category = 'config' AS is_ai FROM f)"""


def severity_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.at_least_severe(scored(spark, sf_dir), 2).groupBy("sev_rank", "engine").agg(F.count("*").alias("n"))


def priority_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines worth a close look."""
    return selection.priority(_ranked(spark, sf_dir), ["path", "line"]).select("path", "line", "rule_id", "sev_rank", "engine")


def priority_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where nothing is severe: the first medium ones, and what concerns AI."""
    rows = _ranked(spark, sf_dir).filter("sev_rank >= 2 and not has_flow and engine != 'crossfile' and reachability is null")
    return selection.priority(rows, ["path", "line", "rule_id"]).select("path", "line", "rule_id", "sev_rank")


def kill_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.kill_chains(read(spark, sf_dir, "documents"), TEMPLATES, "text", "doc_id")


def _flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = scored(spark, sf_dir)
    trace = F.array(F.col("line") - 1, F.col("line"), F.col("line") + 2)
    return rows, rows.filter("has_flow").select("path", "line", "rule_id", "cwe", trace.alias("trace"), "unconfirmed")


def absorbed_by_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when flows absorb the pattern findings on their way."""
    return selection.without_absorbed(*_flows(spark, sf_dir)).select("path", "line", "rule_id", "has_flow")


def rule_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five examples of each rule: the surest first."""
    rows = scored(spark, sf_dir).select("rule_id", "path", "line", "confidence")
    return selection.first_of_each(rows, ["rule_id"], [F.col("confidence").desc(), F.col("path"), F.col("line")], 5)


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = [("severe", F.col("sev_rank") <= 2), ("sure", F.col("confidence") >= 0.5), ("confirmed", ~F.col("unconfirmed")), ("with_flow", F.col("has_flow"))]
    return selection.stage_counts(scored(spark, sf_dir), stages)


def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of three engines as passes of a plan, counted in its order."""
    rows = scored(spark, sf_dir)
    merged = selection.in_plan_order([(e, rows.filter(F.col("engine") == e)) for e in ("taint", "legacy", "authz")])
    return merged.groupBy("pass_no", "pass_name").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


def cases_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are all lines of an order that should be findings of R1 or R2 severe ones?"""
    rows = scored(spark, sf_dir)
    expected = rows.filter("rule_id in ('R1', 'R2')").select(F.col("path").alias("case_id"), "path", "line", "rule_id")
    return selection.all_found(expected, selection.at_least_severe(rows, 2))


def first_use_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each view of a user the number of the first purchase behind it."""
    events = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("line"), "event_type")
    return selection.first_after(events.filter("event_type = 'view'"), events.filter("event_type = 'purchase'"), ["user_id"])


QUERIES = {
    f.__name__: f
    for f in (severity_floor, priority_findings, priority_fallback, kill_chains, absorbed_by_flows, rule_examples, stage_counts, plan_order, cases_met, first_use_after)
}
_TOKENS = " UNION ALL ".join(f"SELECT '{name}' AS chain, '{t}' AS token, doc_id FROM documents WHERE contains(lower(text), '{t}')" for name, tokens in TEMPLATES.items() for t in tokens)
ORACLES = {
    "severity_floor": "WITH " + _SCORED + " SELECT sev_rank, engine, count(*) AS n FROM f WHERE sev_rank <= 2 GROUP BY 1, 2",
    "priority_findings": _RANKED + """
SELECT path, line, rule_id, sev_rank, engine FROM r WHERE engine <> 'depguard' AND (sev_rank <= 1 OR has_flow OR engine = 'crossfile' OR reachable OR (is_ai AND sev_rank <> 4))""",
    "priority_fallback": _RANKED + """,
m AS (SELECT * FROM r WHERE engine NOT IN ('depguard', 'crossfile') AND sev_rank >= 2 AND NOT has_flow AND NOT reachable),
t AS (SELECT path, line, rule_id, sev_rank, is_ai FROM m WHERE sev_rank = 2 AND confidence >= 0.6 ORDER BY path, line, rule_id LIMIT 150)
SELECT path, line, rule_id, sev_rank FROM t
UNION ALL (SELECT path, line, rule_id, sev_rank FROM m WHERE is_ai AND sev_rank <> 4 EXCEPT ALL SELECT path, line, rule_id, sev_rank FROM t WHERE is_ai)""",
    "kill_chains": f"""
SELECT chain, count(DISTINCT token) AS tokens, count(DISTINCT doc_id) AS contributors, min(doc_id) AS first_source FROM ({_TOKENS}) GROUP BY chain HAVING count(DISTINCT token) >= 2""",
    "absorbed_by_flows": "WITH " + _SCORED + """,
t AS (SELECT path, line - 1 AS at, rule_id, cwe FROM f WHERE has_flow AND NOT unconfirmed UNION ALL SELECT path, line + 2, rule_id, cwe FROM f WHERE has_flow AND NOT unconfirmed)
SELECT path, line, rule_id, has_flow FROM f WHERE has_flow OR NOT EXISTS (FROM t WHERE t.path = f.path AND t.at = f.line AND t.rule_id <> f.rule_id AND t.cwe = f.cwe)""",
    "rule_examples": "WITH " + _SCORED + """
SELECT rule_id, path, line, confidence FROM f QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY confidence DESC, path, line) <= 5""",
    "stage_counts": "WITH " + _SCORED + """
SELECT 0 AS place, 'all' AS stage, count(*) AS kept FROM f UNION ALL SELECT 1, 'severe', count(*) FROM f WHERE sev_rank <= 2
UNION ALL SELECT 2, 'sure', count(*) FROM f WHERE sev_rank <= 2 AND confidence >= 0.5
UNION ALL SELECT 3, 'confirmed', count(*) FROM f WHERE sev_rank <= 2 AND confidence >= 0.5 AND NOT unconfirmed
UNION ALL SELECT 4, 'with_flow', count(*) FROM f WHERE sev_rank <= 2 AND confidence >= 0.5 AND NOT unconfirmed AND has_flow""",
    "plan_order": "WITH " + _SCORED + """
SELECT CASE engine WHEN 'taint' THEN 0 WHEN 'legacy' THEN 1 ELSE 2 END AS pass_no, engine AS pass_name, count(*) AS n, min(path) AS first_path FROM f GROUP BY 1, 2""",
    "cases_met": "WITH " + _SCORED + """,
h AS (SELECT DISTINCT path, line, rule_id, true AS hit FROM f WHERE sev_rank <= 2)
SELECT path AS case_id, bool_and(coalesce(hit, false)) AS met FROM f LEFT JOIN h USING (path, line, rule_id) WHERE rule_id IN ('R1', 'R2') GROUP BY path""",
    "first_use_after": """
SELECT v.user_id, v.event_id AS line, min(p.event_id) AS first_use FROM events v LEFT JOIN events p ON p.user_id = v.user_id AND p.event_type = 'purchase' AND p.event_id > v.event_id
WHERE v.event_type = 'view' GROUP BY 1, 2""",
}
