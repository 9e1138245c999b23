"""Loops and proofs over order lines: lines of return flag R are calls of the order with the line's part number, and definitions of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.operators import loops, proofs
from sievekit.operators.materialise import stored


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def call_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that call one another in a circle."""
    calls = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("callee"))
    return loops.feedback_loops(calls)


def selected_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders select parts from suppliers' registries; a part of size 1 to 3 has a capability, and returned parts call the order back."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    orders = orders.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("file")), "o_custkey").drop("o_custkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("returned"))
    lines = lines.join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("home")), "l_suppkey").join(orders, "l_orderkey")
    # Orders are even numbers, a nation's parts odd ones; names are spelt at the end.
    order, part = F.col("l_orderkey") * 2, (F.col("l_partkey") * 2**31 + F.col("home")) * 2 + 1
    lines = stored(lines).withColumns({"order": order, "part": part})
    dispatches = lines.select(F.col("order").alias("node"), "file", F.col("l_orderkey").alias("fn"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("registry"), F.lit(1).alias("model_line"))
    imports = lines.filter("file != home").select("file", F.col("l_suppkey").alias("local_name"), F.col("home").alias("target_file"), F.col("l_suppkey").alias("target_name")).distinct()
    registries = lines.select(F.col("part").alias("node"), F.col("home").alias("file"), F.col("l_suppkey").alias("registry"), F.col("l_partkey").alias("place"), F.col("l_partkey").alias("function"))
    able = F.element_at(F.array(F.lit("shell"), F.lit("file write"), F.lit("unpinned package supply chain execution")), F.col("p_size"))
    parts = read(spark, sf_dir, "part").filter("p_size <= 3").select(F.col("p_partkey").alias("l_partkey"), able.alias("capability"), F.col("p_size").alias("line"))
    capabilities = lines.join(parts, "l_partkey").select(F.col("part").alias("node"), F.col("home").alias("file"), F.col("l_partkey").alias("function"), "capability", "line").distinct()
    call = lambda caller, callee: F.struct(F.col(caller).alias("caller"), F.col(callee).alias("callee"))
    calls = F.when(F.col("returned"), F.array(call("order", "part"), call("part", "order"))).otherwise(F.array(call("order", "part")))
    out = loops.capability_findings(dispatches, imports, registries, capabilities, lines.select(F.inline(calls)))
    name = lambda letter, c: F.concat(F.lit(letter), c)
    return out.withColumns({
        "file": name("n", "file"), "fn": name("o", "fn"), "registry": name("s", "registry"), "registry_file": name("n", "registry_file"), "sink_function": name("p", "sink_function"),
        "capabilities": F.array_join("capabilities", ","), "cwe": F.array_join(F.transform("cwe", lambda x: x.cast("string")), ","),
    })


#: An operation for each line number.
_OPERATION = ("copy", "arithmetic", "join", "format", "character", "convert", "copy")


def _proven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a value, its lines are its definitions. A line of flag R rests on the order with its part's number, one of flag A on that with
    its supplier's too; the others are literals, numbers where the line is open."""
    lines = read(spark, sf_dir, "lineitem").withColumn("definition", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    literal = F.when(~F.col("l_returnflag").isin("R", "A"), F.when(F.col("l_linestatus") == "O", "number").otherwise("text"))
    operation = F.element_at(F.array(*map(F.lit, _OPERATION)), F.col("l_linenumber").cast("int"))
    definitions = lines.select(F.col("l_orderkey").alias("value"), "definition", operation.alias("operation"), literal.alias("literal"))
    first = lines.filter("l_returnflag in ('R', 'A')").select("definition", F.col("l_partkey").alias("part"))
    second = lines.filter("l_returnflag = 'A'").select("definition", F.col("l_suppkey").alias("part"))
    return proofs.bounded(definitions, first.unionByName(second))


def bounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are proven to hold numbers or bounded text."""
    return _proven(spark, sf_dir)


def unbounded_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings at order lines, less those of forged logs where all that the line logs is bounded; a line logs its own order and the one of its part's number."""
    lines = read(spark, sf_dir, "lineitem")
    findings = lines.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), F.when(F.col("l_tax") > 0.02, "TNT-LOG-001").otherwise("TNT-SQL-001").alias("rule_id"))
    own = findings.select("path", "line", F.col("path").alias("value"))
    other = lines.filter("l_discount > 0.05").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("value"))
    return proofs.without_bounded(findings, own.unionByName(other), _proven(spark, sf_dir))


_BOUNDED = """
WITH RECURSIVE d AS (
  SELECT DISTINCT l_orderkey AS value, l_orderkey || ':' || l_linenumber AS definition, ['copy', 'arithmetic', 'join', 'format', 'character', 'convert', 'copy'][l_linenumber] AS operation,
    CASE WHEN l_returnflag NOT IN ('R', 'A') THEN CASE WHEN l_linestatus = 'O' THEN 'number' ELSE 'text' END END AS literal FROM lineitem),
p AS (
  SELECT DISTINCT definition, part FROM (
    SELECT l_orderkey || ':' || l_linenumber AS definition, l_partkey AS part FROM lineitem WHERE l_returnflag IN ('R', 'A')
    UNION ALL SELECT l_orderkey || ':' || l_linenumber, l_suppkey FROM lineitem WHERE l_returnflag = 'A')),
fixed AS (SELECT value, definition, CASE WHEN operation = 'convert' THEN 'number' ELSE literal END AS kind FROM d WHERE operation = 'convert' OR literal IS NOT NULL),
parts AS (SELECT d.value, d.definition, d.operation, p.part FROM d JOIN p USING (definition) WHERE literal IS NULL AND operation <> 'convert'),
ways AS (SELECT value, count(*) AS n FROM d GROUP BY value),
r(value, kind) USING KEY (value) AS (
  SELECT value, min(kind) FROM fixed GROUP BY value HAVING count(*) = (SELECT n FROM ways w WHERE w.value = fixed.value) AND min(kind) = max(kind)
  UNION
  SELECT value, min(kind) FROM (
    SELECT value, definition, kind FROM fixed
    UNION ALL
    SELECT parts.value, definition, CASE operation WHEN 'copy' THEN CASE WHEN count(*) FILTER (x.kind = 'number') = count(*) THEN 'number' WHEN count(*) FILTER (x.kind = 'number') = 0 THEN 'text' END
      WHEN 'arithmetic' THEN CASE WHEN count(*) FILTER (x.kind = 'number') = count(*) THEN 'number' END
      WHEN 'join' THEN CASE WHEN count(*) FILTER (x.kind = 'number') = 0 THEN 'text' END WHEN 'format' THEN 'text' END
    FROM parts LEFT JOIN recurring.r x ON x.value = part GROUP BY parts.value, definition, operation HAVING count(x.value) = count(*)) s
  WHERE kind IS NOT NULL AND (SELECT count(*) FROM r) > 0 AND value NOT IN (SELECT value FROM recurring.r)
  GROUP BY value HAVING count(*) = (SELECT n FROM ways w WHERE w.value = s.value) AND min(kind) = max(kind))"""

QUERIES = {f.__name__: f for f in (call_loops, selected_tools, bounded_values, unbounded_logs)}
ORACLES = {
    "call_loops": """
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'R'),
inner_ AS (SELECT a, b FROM e WHERE a IN (SELECT b FROM e)),
r(a, b) AS (SELECT a, b FROM inner_ UNION SELECT r.a, e.b FROM r JOIN inner_ e ON e.a = r.b),
s AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a)
SELECT s.component, count(DISTINCT s.node) AS members, count(*) FILTER (t.node IS NOT NULL) AS inner_edges
FROM s LEFT JOIN e ON e.a = s.node LEFT JOIN s t ON t.node = e.b AND t.component = s.component GROUP BY s.component""",
    "bounded_values": _BOUNDED + " SELECT value, kind FROM r",
    "unbounded_logs": _BOUNDED + """,
logged AS (
  SELECT l_orderkey AS path, l_linenumber AS line, l_orderkey AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount > 0.05),
safe AS (SELECT path, line FROM logged LEFT JOIN r USING (value) GROUP BY path, line HAVING count(*) = count(kind)),
f AS (SELECT l_orderkey AS path, l_linenumber AS line, CASE WHEN l_tax > 0.02 THEN 'TNT-LOG-001' ELSE 'TNT-SQL-001' END AS rule_id FROM lineitem)
SELECT f.* FROM f WHERE NOT (rule_id = 'TNT-LOG-001' AND EXISTS (SELECT 1 FROM safe s WHERE s.path = f.path AND s.line = f.line))""",
}
