"""Queries that attribute, bind and judge findings: order lines, events and people stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.operators import evaluation, graph, joins
from sievekit.plans.findings import _SCORED, scored
from sievekit.plans.graphs import read


def attributed_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each supplier (function) its earliest order line (finding), on one line the surest."""
    lines = read(spark, sf_dir, "lineitem")
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    found = lines.select(F.col("l_suppkey").alias("node"), (F.col("l_partkey") % 500).alias("line"), F.col("l_discount").alias("confidence"), seq.alias("seq"), F.concat(F.lit("R"), (seq % 9).cast("string")).alias("rule_id"))
    return graph.attributed_sinks(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node")), found)


def persistent_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups write and errors read a store whose key is the user's number; values tell sources and sinks."""
    events = read(spark, sf_dir, "events")
    functions = events.select(F.col("event_id").alias("node"), (F.col("value") > 60).alias("has_source"), (F.col("value") < 20).alias("has_sink"))
    role = F.when(F.col("event_type") == "signup", "write").when(F.col("event_type") == "error", "read")
    channels = events.select(F.lit("event").alias("kind"), (F.col("user_id") % 200).alias("key"), F.col("event_id").alias("fn_id"), role.alias("role"))
    return graph.persistent_flows(functions, channels).select("key", "writer", "reader")


def unresolved_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders write and finished ones read the store of a customer; of a third the file isn't known."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("key"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("file"))
    writes = orders.filter("o_orderstatus = 'O'").select("key", "file", F.col("o_orderkey").alias("writer"))
    reads = orders.filter("o_orderstatus = 'F'").select("key", "file", F.col("o_orderkey").alias("reader"))
    return joins.unresolved_match(writes, reads, ["key"]).select("key", "writer", "reader")


def bound_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parameter an argument fills: three lists of parameters, by place or by name."""
    k, z = F.col("p_partkey"), F.col("p_size")
    params = F.when(z % 3 == 0, F.array(F.lit("self"), F.lit("a"), F.lit("b"))).when(z % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("cls")))
    keyword = F.when(k % 5 == 0, "b").when(k % 5 == 1, "z")
    rows = read(spark, sf_dir, "part").select("p_partkey", params.alias("params"), (k % 3).cast("int").alias("position"), keyword.alias("keyword"))
    return rows.select("p_partkey", joins.bound_parameter(F.col("params"), F.col("position"), F.col("keyword")).cast("long").alias("parameter"))


def not_yet_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lesser findings that stand neither on nor near a critical one of the same kind."""
    rows = scored(spark, sf_dir)
    return joins.not_yet_reported(rows.filter("sev_rank > 0"), rows.filter("sev_rank = 0")).select("path", "line", "rule_id")


def credited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases with an expected rule, category and CWE: how were they met?"""
    k = F.col("o_orderkey")
    category = F.element_at(F.array(F.lit("injection"), F.lit("secrets"), F.lit("none")), (k % 3 + 1).cast("int"))
    cases = read(spark, sf_dir, "orders").select(k.alias("case_id"), k.alias("path"), F.concat(F.lit("R"), (k % 9).cast("string")).alias("rule_id"), category.alias("category"), F.when(k % 2 == 0, 79).otherwise(89).alias("cwe"))
    return evaluation.credited(cases, scored(spark, sf_dir).select("path", "rule_id", "category", "cwe"))


def pairs_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cases: returned lines are hits, finished ones are after the fix."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("case_id"), (F.col("l_linestatus") == "F").alias("fixed"), ((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.06)).alias("hit"))
    return evaluation.pairs_hold(rows)


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as repositories: customers are findings, those in debt urgent ones, suppliers the baseline."""
    counted = lambda name, p: read(spark, sf_dir, name).groupBy(F.col(f"{p}_nationkey").alias("repo")).agg(F.count("*").alias("total"), F.count_if(F.col(f"{p}_acctbal") < 0).alias("urgent"))
    return evaluation.drift(counted("customer", "c"), counted("supplier", "s"), 50, 5)


def unreviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent findings whose fingerprint no finding of a finished line has."""
    rows = scored(spark, sf_dir).withColumn("fingerprint", F.sha2(F.concat_ws("|", "path", "rule_id"), 256))
    return evaluation.unreviewed(rows, rows.filter("not unconfirmed")).select("path", "line", "rule_id")


def zipped_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of a part's batch with the answers of the same place; some are missing, some batches have none."""
    parts = read(spark, sf_dir, "part")
    asked = parts.select(F.col("p_partkey").alias("batch"), F.sequence(F.lit(1), F.col("p_size") % 5 + 1).alias("items"))
    answers = parts.filter("p_size % 4 != 0").select(F.col("p_partkey").alias("batch"), F.when(F.col("p_size") % 3 > 0, F.sequence(F.lit(1), F.col("p_size") % 3)).alias("results"))
    return joins.zipped(asked, answers).groupBy("batch").agg(F.count("*").alias("asked"), F.count("result").alias("answered"))


QUERIES = {
    f.__name__: f
    for f in (attributed_sinks, persistent_flows, unresolved_stores, bound_parameters, not_yet_reported, credited, pairs_hold, drift, unreviewed, zipped_answers)
}
ORACLES = {
    "attributed_sinks": """
WITH f AS (SELECT l_suppkey AS node, l_partkey % 500 AS line, -l_discount AS c, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
b AS (SELECT node, min(struct_pack(line := line, c := c, seq := seq)) AS b FROM f GROUP BY node)
SELECT s_suppkey AS node, b.line AS sink_line, 'R' || (b.seq % 9) AS sink_rule_id FROM supplier LEFT JOIN b ON node = s_suppkey""",
    "persistent_flows": """
SELECT DISTINCT w.user_id % 200 AS key, w.event_id AS writer, r.event_id AS reader FROM events w JOIN events r ON w.user_id % 200 = r.user_id % 200
WHERE w.event_type = 'signup' AND r.event_type = 'error' AND w.value > 60 AND r.value < 20""",
    "unresolved_stores": """
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey AS key, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS file FROM orders)
SELECT w.key, w.k AS writer, r.k AS reader FROM o w JOIN o r USING (key) WHERE w.s = 'O' AND r.s = 'F' AND (w.file IS NULL OR r.file IS NULL OR w.file = r.file)""",
    "bound_parameters": """
WITH p AS (SELECT p_partkey, p_size % 3 AS z, p_partkey % 3 AS pos, CASE p_partkey % 5 WHEN 0 THEN 'b' WHEN 1 THEN 'z' END AS kw FROM part),
q AS (SELECT *, CASE z WHEN 0 THEN ['self', 'a', 'b'] WHEN 1 THEN ['a', 'b'] ELSE ['cls'] END AS params, CASE WHEN z = 1 THEN pos ELSE pos + 1 END AS place FROM p)
SELECT p_partkey, CAST(CASE WHEN kw IS NOT NULL THEN nullif(coalesce(list_position(params, kw), 0), 0) - 1 WHEN place < len(params) THEN place END AS BIGINT) AS parameter FROM q""",
    "not_yet_reported": "WITH " + _SCORED + """
SELECT path, line, rule_id FROM f WHERE sev_rank > 0
AND NOT EXISTS (FROM f g WHERE g.sev_rank = 0 AND g.path = f.path AND (g.line = f.line OR (abs(g.line - f.line) <= 3 AND g.cwe = f.cwe)))""",
    "credited": "WITH " + _SCORED + """,
m AS (SELECT o_orderkey AS case_id, min(CASE WHEN f.rule_id = 'R' || (o_orderkey % 9) THEN 1 WHEN f.category = ['injection', 'secrets', 'none'][o_orderkey % 3 + 1] THEN 2
  WHEN f.cwe = CASE WHEN o_orderkey % 2 = 0 THEN 79 ELSE 89 END THEN 3 END) AS met FROM orders LEFT JOIN f ON path = o_orderkey GROUP BY 1)
SELECT case_id, CASE met WHEN 1 THEN 'rule' WHEN 2 THEN 'category' WHEN 3 THEN 'cwe' END AS credit FROM m""",
    "pairs_hold": """
WITH r AS (SELECT l_partkey AS case_id, l_linestatus = 'F' AS fixed, l_returnflag = 'R' AND l_tax > 0.06 AS hit FROM lineitem)
SELECT case_id, bool_or(hit AND NOT fixed) AS detected, NOT bool_or(hit AND fixed) AS clean_after_fix FROM r GROUP BY case_id""",
    "drift": """
WITH c AS (SELECT c_nationkey AS repo, count(*) AS total, count(*) FILTER (c_acctbal < 0) AS urgent FROM customer GROUP BY 1),
s AS (SELECT s_nationkey AS repo, count(*) AS total, count(*) FILTER (s_acctbal < 0) AS urgent FROM supplier GROUP BY 1)
SELECT c.repo, c.total, c.urgent, c.total - coalesce(s.total, 0) > 50 OR c.urgent - coalesce(s.urgent, 0) > 5 AS failed FROM c LEFT JOIN s USING (repo)""",
    "unreviewed": "WITH " + _SCORED + """
SELECT path, line, rule_id FROM f WHERE sev_rank <= 1 AND NOT EXISTS (FROM f g WHERE NOT g.unconfirmed AND g.path = f.path AND g.rule_id = f.rule_id)""",
    "zipped_answers": """
SELECT p_partkey AS batch, CAST(p_size % 5 + 1 AS BIGINT) AS asked, CAST(CASE WHEN p_size % 4 <> 0 THEN least(p_size % 3, p_size % 5 + 1) ELSE 0 END AS BIGINT) AS answered FROM part""",
}
