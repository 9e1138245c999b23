"""Guards and matchings over lines of documents, events and order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.operators import evaluation, guards, joins
from sievekit.operators.lines import lines_of
from sievekit.plans.findings import scored
from sievekit.plans.scan import _WHOLE

#: Words that say nothing of what a line is about.
STOP = ["the", "of", "and", "to", "in", "a", "de", "la", "der", "die", "is", "en"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _near(spark: SparkSession, sf_dir: str, before: int, after: int) -> DataFrame:
    """Lines with the word that are sinks; lines with the word was show a call, lines with a bar or a colon a shape."""
    lines = lines_of(read(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "path")
    sinks = lines.filter("line like '% that %'").select(F.concat_ws(":", "path", "line_no").alias("finding"), "path", F.col("line_no").alias("line"))
    kinds = F.array_compact(F.array(F.when(F.col("line").contains(" was "), F.lit("call")), F.when(F.col("line").rlike("[:|]"), F.lit("shape"))))
    found = guards.near_evidence(sinks, lines, kinds, F.array(F.lit("shape")), before, after, STOP)
    return found.select("finding", F.array_join("evidence", ",").alias("evidence"))


def sanitized_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks up to ten lines to either side of a sink that name what it uses."""
    return _near(spark, sf_dir, guards.SANITIZER_REACH, guards.SANITIZER_REACH)


def guarded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks on the forty lines before a sink that name what it uses."""
    return _near(spark, sf_dir, guards.GUARD_REACH, 0)


def dominating_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as lines of a file: a click opens a block that lasts by its value, a view tests a variable in its innermost block, a
    signup assigns one, the others use one."""
    k = F.get_json_object("props", "$.k").cast("long")
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.lit("f").alias("scope"), F.col("event_id").alias("line"), "event_type", "value", (k % 4).alias("var"), k.alias("k"))
    blocks = events.filter("event_type = 'click'").select("path", F.col("line").alias("block"), (F.col("line") + 1).alias("begin"), (F.col("line") + 1 + F.floor(F.col("value") * 40)).alias("end"))
    views = events.filter("event_type = 'view'").select("path", "line", "var", F.col("line").alias("point_id"), F.when(F.col("k") < 50, "membership").otherwise("prefix").alias("kind"))
    tests = joins.innermost(views, blocks, "path", "line", "begin", "end", ["block"]).filter("block is not null").select("path", "block", "var", "line", "kind")
    sinks = events.filter("event_type not in ('click', 'view', 'signup')").select(F.col("line").alias("finding"), "path", "scope", "line", "var")
    return guards.dominating_guards(sinks, blocks, tests, events.filter("event_type = 'signup'").select("path", "scope", "var", "line"))


def distinct_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines against one labelled sink an order and, for cheap orders, a decoy; how many findings of each rule are distinct hits."""
    # Findings are told apart by numbers, names are made of what is left.
    found = scored(spark, sf_dir).select("path", "line", "q", "rule_id", "confidence").distinct()
    found = found.withColumn("cwe", F.when(F.col("q") % 5 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("q") % 3).cast("int"))))
    found = found.select(F.concat_ws(":", "path", "line", "q", "rule_id", F.col("confidence").cast("string")).alias("finding"), "path", (F.col("line") * 7 + F.col("q")).alias("line"), "cwe", "rule_id")
    orders = read(spark, sf_dir, "orders")
    expected = orders.select(
        F.col("o_orderkey").alias("sink"), F.col("o_orderkey").alias("path"), (F.col("o_orderkey") % 60).alias("line_hint"), (F.col("o_orderkey") % 3).cast("int").alias("cwe"),
        F.when(F.col("o_orderstatus") == "P", "R2").alias("native_rule"),
    )
    decoys = orders.filter("o_totalprice < 100000").select(F.col("o_orderkey").alias("path"), F.lit(0).alias("first"), F.lit(20).alias("last"), F.lit(1).alias("cwe"))
    return evaluation.rule_scores(evaluation.distinct_findings(found, expected, decoys))


def _near_sql(before: int, after: int) -> str:
    opens, closes = ("length(line) - length(translate(line, '" + x + "', ''))" for x in ("([{", ")]}"))
    return "WITH " + _WHOLE.strip() + f""",
d AS (SELECT doc_id, line_no, line, sum({opens} - ({closes})) OVER (PARTITION BY doc_id ORDER BY line_no) AS s FROM lines),
e AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY line_no)) AS depth FROM d),
t AS (
  SELECT doc_id, line_no, coalesce(sum(CASE WHEN depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stmt, line LIKE '% that %' AS sink,
    contains(line, ' was ') AS is_call, regexp_matches(line, '[:|]') AS is_shape,
    list_filter(list_distinct(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*')), lambda w: NOT list_contains({STOP}, w)) AS words FROM e),
k AS (SELECT doc_id, line_no, stmt, words, 'call' AS kind FROM t WHERE is_call UNION ALL SELECT doc_id, line_no, stmt, words, 'shape' FROM t WHERE is_shape)
SELECT a.doc_id || ':' || a.line_no AS finding, string_agg(DISTINCT kind, ',' ORDER BY kind) AS evidence
FROM t a JOIN k ON k.doc_id = a.doc_id AND (k.line_no = a.line_no OR (k.line_no BETWEEN a.line_no - {before} AND a.line_no + {after} AND list_has_any(k.words, a.words)) OR (kind = 'shape' AND k.stmt = a.stmt))
WHERE a.sink GROUP BY a.doc_id, a.line_no"""


QUERIES = {f.__name__: f for f in (sanitized_sinks, guarded_lines, dominating_guards, distinct_scores)}
ORACLES = {
    "sanitized_sinks": _near_sql(guards.SANITIZER_REACH, guards.SANITIZER_REACH),
    "guarded_lines": _near_sql(guards.GUARD_REACH, 0),
    "dominating_guards": """
WITH e AS (SELECT user_id AS path, event_id AS line, event_type AS t, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
b AS (SELECT path, line AS block, line + 1 AS b0, line + 1 + CAST(floor(value * 40) AS BIGINT) AS b1 FROM e WHERE t = 'click'),
g AS (
  SELECT v.path, arg_max(b.block, b.b0) AS block, v.k % 4 AS var, v.line, CASE WHEN v.k < 50 THEN 'membership' ELSE 'prefix' END AS kind
  FROM e v JOIN b ON b.path = v.path AND v.line BETWEEN b0 AND b1 WHERE v.t = 'view' GROUP BY v.path, v.line, v.k),
s AS (
  SELECT x.path, x.line, x.k % 4 AS var, coalesce((SELECT max(a.line) FROM e a WHERE a.t = 'signup' AND a.path = x.path AND a.k % 4 = x.k % 4 AND a.line < x.line), 0) AS since
  FROM e x WHERE x.t NOT IN ('click', 'view', 'signup'))
SELECT s.line AS finding, min(struct_pack(l := g.line, kind := g.kind)).l AS guard_line, min(struct_pack(l := g.line, kind := g.kind)).kind AS kind
FROM s JOIN b ON b.path = s.path AND s.line BETWEEN b0 AND b1 JOIN g ON g.path = s.path AND g.block = b.block AND g.var = s.var AND g.line > s.since AND g.line < s.line GROUP BY s.line""",
}
