"""Graph queries over suppliers and parts, conversations, nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.operators import dependencies, graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers (even nodes) use parts (odd nodes) that they deliver; a part uses the supplier with its number. One row for each two nodes."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("has_args"))
    down = lines.select((F.col("l_suppkey") * 2).alias("caller"), (F.col("l_partkey") * 2 + 1).alias("callee"), "has_args")
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size"))
    up = parts.join(suppliers, "k").select((F.col("k") * 2 + 1).alias("caller"), (F.col("k") * 2).alias("callee"), (F.col("p_size") > 10).alias("has_args"))
    return down.unionByName(up)


_EDGES = """
edges AS (
  SELECT l_suppkey * 2 AS caller, l_partkey * 2 + 1 AS callee, bool_or(l_returnflag = 'R') AS has_args FROM lineitem GROUP BY 1, 2
  UNION ALL
  SELECT p_partkey * 2 + 1, s_suppkey * 2, p_size > 10 FROM part JOIN supplier ON p_partkey = s_suppkey)"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").filter("p_size = 1").select((F.col("p_partkey") * 2 + 1).alias("node"))


def _reach(name: str, edges: str, near: str, far: str, seed: str) -> str:
    """A recursion that meets each node once, so layer by layer."""
    return f"""
{name}(node, dist) USING KEY (node) AS (
  {seed}
  UNION
  SELECT e.{far}, min(r.dist) + 1 FROM {name} r JOIN {edges} e ON e.{near} = r.node LEFT JOIN recurring.{name} old ON old.node = e.{far} WHERE old.node IS NULL GROUP BY e.{far})"""


_SEED = "SELECT p_partkey * 2 + 1, 0 FROM part WHERE p_size = 1"


def caller_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All callers above the smallest parts, with the smallest predecessor."""
    return graph.layers(supply_edges(spark, sf_dir), _seeds(spark, sf_dir)).select("node", "dist", "pred")


def forward_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(supply_edges(spark, sf_dir), _seeds(spark, sf_dir), upward=False)


def gated_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers in which only edges with arguments count after the first hop."""
    edges = supply_edges(spark, sf_dir)
    return graph.layers(edges.filter("has_args"), _seeds(spark, sf_dir), first_edges=edges).select("node", "dist")


def edge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an edge: three-valued taint, first line, slots."""
    lines = read(spark, sf_dir, "lineitem")
    calls = lines.select(
        F.col("l_suppkey").alias("caller"), (F.col("l_partkey") % 97).alias("callee"), (F.col("l_quantity") > 25).alias("has_args"),
        F.when(F.col("l_returnflag") == "N", None).otherwise(F.col("l_tax") > 0.04).alias("carries_taint"), F.col("l_linenumber").cast("long").alias("line"),
        F.array(F.col("l_linestatus")).alias("tainted_slots"),
    )
    out = graph.edges_of_calls(calls)
    taint = F.coalesce(F.col("carries_taint").cast("string"), F.lit("unknown"))
    return out.withColumns({"tainted_slots": F.array_join("tainted_slots", ","), "carries_taint": taint})


def call_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = graph.layers(supply_edges(spark, sf_dir), _seeds(spark, sf_dir))
    return graph.paths(reached).select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def package_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest chains from region 0 and 1 over nations to customers and suppliers."""
    nation = read(spark, sf_dir, "nation")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    edges = (
        nation.select(name("r", "n_regionkey").alias("caller"), name("n", "n_nationkey").alias("callee"))
        .unionByName(read(spark, sf_dir, "customer").select(name("n", "c_nationkey").alias("caller"), name("c", "c_custkey").alias("callee")))
        .unionByName(read(spark, sf_dir, "supplier").select(name("n", "s_nationkey").alias("caller"), name("s", "s_suppkey").alias("callee")))
    )
    direct = read(spark, sf_dir, "region").filter("r_regionkey < 2").select(name("r", "r_regionkey").alias("node"))
    return dependencies.chains(edges, direct).select("node", F.array_join("chain", ">").alias("chain"))


def handoff_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation hand over to the next one; those after a system turn are armed, long ones have a schema that stops it."""
    turns = read(spark, sf_dir, "conversations").withColumn("node", F.col("conv_id") * 1000 + F.col("turn"))
    nodes = turns.select("node", (F.col("role") == "system").alias("armed"), (F.length("text") > 1200).alias("has_schema"))
    edges = turns.select(F.col("node").alias("caller"), (F.col("node") + 1).alias("callee"))
    edges = edges.join(turns.select(F.col("node").alias("callee")), "callee")
    return graph.handoffs(nodes, edges).select("node", "dist")


def summary_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which brands each node can come to use."""
    parts = read(spark, sf_dir, "part").filter("p_size = 1").select((F.col("p_partkey") * 2 + 1).alias("node"), F.array("p_brand").alias("value"))
    combine = lambda rows: rows.select("node", F.explode("value").alias("v")).distinct().groupBy("node").agg(F.collect_list("v").alias("value"))  # noqa: E731  25 brands
    edges = supply_edges(spark, sf_dir).select("caller", "callee")
    return graph.fixpoint(parts, "node", edges, combine).select("node", F.array_join("value", ",").alias("brands"))


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts as functions of a few files; their numbers decide what is known of each."""
    parts = read(spark, sf_dir, "part").select((F.col("p_partkey") * 2 + 1).alias("node"), (F.col("p_size") % 7).cast("int").alias("file"), (F.col("p_size") == 1).alias("has_sink"), F.lit(False).alias("has_source"), F.col("p_partkey").alias("k"))
    suppliers = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("node"), (F.col("s_nationkey") % 7).cast("int").alias("file"), (F.col("s_acctbal") < 1000).alias("has_sink"), (F.col("s_acctbal") > 8500).alias("has_source"), F.col("s_suppkey").alias("k"))
    k = F.col("k")
    listed = lambda n, *values: F.when(k % n == 1, F.array(*map(F.lit, values))).when(k % n == 2, F.array().cast("array<string>"))
    return parts.unionByName(suppliers).select(
        "node", "file", "has_sink", "has_source", (k % 2 == 0).alias("operator_only"), listed(3, "0").alias("sink_params"), listed(4, "1").alias("return_params"),
        listed(5, "f0", "f1", "f2").alias("sink_calls"), listed(6, "f1", "f3").alias("returned_calls"),
        F.when(k % 4 == 0, F.array(F.lit(117))).when(k % 4 == 1, F.array(F.lit(89))).otherwise(F.array().cast("array<int>")).alias("sink_cwe"), (k % 5 == 0).alias("classified"),
    )


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few of the order lines hand anything over; of some it isn't known what."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_linenumber").alias("n"), F.count("*").alias("many"), F.max("l_tax").alias("tax"))
    down = lines.select((F.col("l_suppkey") * 2).alias("caller"), (F.col("l_partkey") * 2 + 1).alias("callee"), "n", "tax")
    parts, suppliers = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    up = parts.join(suppliers, F.col("p_partkey") == F.col("s_suppkey")).select((F.col("p_partkey") * 2 + 1).alias("caller"), (F.col("s_suppkey") * 2).alias("callee"), (F.col("p_size") % 7 + 1).alias("n"), F.lit(0.08).alias("tax"))
    slots = F.when(F.col("n") == 1, F.array(F.lit("0"))).when(F.col("n") == 2, F.array(F.lit("1"))).when(F.col("n") < 6, F.array().cast("array<string>"))
    return down.unionByName(up).select("caller", "callee", F.concat(F.lit("f"), (F.col("callee") % 7).cast("string")).alias("callee_name"), (F.col("tax") > 0.07).alias("has_args"), slots.alias("tainted_slots"))


def cross_file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows from rich suppliers into the smallest parts and poor suppliers, and back, with severity and confidence."""
    return graph.emissions(_calls(spark, sf_dir), _functions(spark, sf_dir))


def merged_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a sink and a return finding between the same two functions one."""
    return graph.merge_directions(cross_file_findings(spark, sf_dir))


_FOUND = """
WITH RECURSIVE x AS (
  SELECT p_partkey * 2 + 1 AS node, p_size % 7 AS file, p_size = 1 AS has_sink, false AS has_source, p_partkey AS k FROM part
  UNION ALL SELECT s_suppkey * 2, s_nationkey % 7, s_acctbal < 1000, s_acctbal > 8500, s_suppkey FROM supplier),
fn AS (
  SELECT node, file, has_sink, has_source, k % 2 = 0 AS operator_only, CASE k % 3 WHEN 1 THEN ['0'] WHEN 2 THEN CAST([] AS VARCHAR[]) END AS sink_params,
    CASE k % 4 WHEN 1 THEN ['1'] WHEN 2 THEN CAST([] AS VARCHAR[]) END AS return_params, CASE k % 5 WHEN 1 THEN ['f0', 'f1', 'f2'] WHEN 2 THEN CAST([] AS VARCHAR[]) END AS sink_calls,
    CASE k % 6 WHEN 1 THEN ['f1', 'f3'] WHEN 2 THEN CAST([] AS VARCHAR[]) END AS returned_calls, CASE k % 4 WHEN 0 THEN 117 WHEN 1 THEN 89 END AS cwe, k % 5 = 0 AS classified FROM x),
c AS (
  SELECT l_suppkey * 2 AS caller, l_partkey * 2 + 1 AS callee, min(l_linenumber) AS n, max(l_tax) AS tax FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT p_partkey * 2 + 1, s_suppkey * 2, p_size % 7 + 1, 0.08 FROM part JOIN supplier ON p_partkey = s_suppkey),
e AS (
  SELECT c.caller, c.callee, 'f' || (c.callee % 7) AS callee_name, tax > 0.07 AS has_args, CASE WHEN n = 1 THEN ['0'] WHEN n = 2 THEN ['1'] WHEN n < 6 THEN CAST([] AS VARCHAR[]) END AS slots FROM c),
g AS (
  SELECT e.*, a.file AS from_file, b.file AS to_file, a.has_sink, a.sink_calls, b.sink_params, b.return_params, CASE WHEN slots IS NOT NULL THEN len(slots) > 0 ELSE has_args END AS passes,
    a.returned_calls IS NULL OR list_contains(a.returned_calls, callee_name) AS returns, b.sink_params IS NULL OR slots IS NULL OR list_has_any(b.sink_params, slots) AS may_hit
  FROM e JOIN fn a ON a.node = e.caller JOIN fn b ON b.node = e.callee),
pass AS (SELECT * FROM g WHERE passes),
ret AS (SELECT * FROM g WHERE returns),
up(node, dist, origin) USING KEY (node) AS (
  SELECT node, 0, node FROM fn WHERE has_sink
  UNION
  SELECT g.caller, min(r.dist) + 1, arg_min(r.origin, r.node) FROM up r JOIN g ON g.callee = r.node AND CASE WHEN r.dist = 0 THEN g.may_hit ELSE g.passes END
    LEFT JOIN recurring.up old ON old.node = g.caller WHERE old.node IS NULL GROUP BY g.caller),""" + _reach("back", "ret", "callee", "caller", "SELECT node, 0 FROM fn WHERE has_source") + "," + _reach(
    "down", "pass", "caller", "callee", "SELECT node, 0 FROM fn WHERE has_source") + "," + _reach("remote", "pass", "caller", "callee", "SELECT node, 0 FROM fn WHERE has_source AND NOT operator_only") + """,
hit AS (
  SELECT DISTINCT g.caller, g.callee, 'sink' AS direction, up.dist AS depth, up.origin AS sink, remote.node IS NULL AS own_input
  FROM g JOIN up ON up.node = g.callee JOIN down ON down.node = g.caller LEFT JOIN remote ON remote.node = g.caller
  WHERE from_file <> to_file AND CASE WHEN up.dist = 0 AND sink_params IS NOT NULL THEN coalesce(list_has_any(sink_params, slots), false) ELSE passes END),
both_ AS (
  SELECT caller, callee, dist AS depth, 0 AS way FROM g JOIN back ON back.node = g.callee WHERE from_file <> to_file AND has_sink AND (sink_calls IS NULL OR list_contains(sink_calls, callee_name))
  UNION ALL SELECT caller, callee, 0, 1 FROM g WHERE from_file <> to_file AND has_sink AND list_has_any(slots, return_params)),
every AS (
  SELECT * FROM hit UNION ALL
  SELECT caller, callee, 'return', min(struct_pack(way := way, depth := depth)).depth, callee, false FROM both_ GROUP BY 1, 2),
found AS (
  SELECT direction, caller, callee, CAST(depth AS INT) AS depth, sink,
    CASE WHEN direction = 'return' AND cwe IS NULL AND NOT classified THEN 'low' WHEN coalesce(cwe = 117, false) OR own_input THEN 'medium' ELSE 'high' END AS severity,
    CASE WHEN own_input THEN least(0.5e0, round(greatest(0.25e0, 0.75e0 - depth * 0.1e0), 4)) ELSE round(greatest(0.25e0, 0.75e0 - depth * 0.1e0), 4) END AS confidence,
    CASE direction WHEN 'sink' THEN 'CF-SINK-001' ELSE 'CF-RETURN-001' END AS rule_id
  FROM every JOIN fn ON fn.node = sink)"""


QUERIES = {
    f.__name__: f
    for f in (caller_layers, forward_reach, gated_layers, edge_summary, call_paths, package_chains, handoff_spread, summary_fixpoint, cross_file_findings, merged_directions)
}
_UP = "WITH RECURSIVE" + _EDGES + "," + _reach("d", "edges", "callee", "caller", _SEED)
_PRED = _UP + """,
p AS (SELECT d.node, d.dist, min(x.node) AS pred FROM d LEFT JOIN edges e ON e.caller = d.node LEFT JOIN d x ON x.node = e.callee AND x.dist = d.dist - 1 GROUP BY 1, 2)"""
ORACLES = {
    "caller_layers": _PRED + " SELECT node, CAST(dist AS INT) AS dist, pred FROM p",
    "forward_reach": "WITH RECURSIVE" + _EDGES + "," + _reach("d", "edges", "caller", "callee", _SEED) + " SELECT node FROM d",
    "gated_layers": "WITH RECURSIVE" + _EDGES + f""",
d(node, dist) USING KEY (node) AS (
  {_SEED}
  UNION
  SELECT e.caller, min(r.dist) + 1 FROM d r JOIN edges e ON e.callee = r.node AND (e.has_args OR r.dist = 0) LEFT JOIN recurring.d old ON old.node = e.caller WHERE old.node IS NULL GROUP BY e.caller)
SELECT node, CAST(dist AS INT) AS dist FROM d""",
    "edge_summary": """
SELECT l_suppkey AS caller, l_partkey % 97 AS callee, bool_or(l_quantity > 25) AS has_args,
  coalesce(CAST(bool_or(CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_tax > 0.04 END) AS VARCHAR), 'unknown') AS carries_taint, CAST(min(l_linenumber) AS BIGINT) AS line,
  string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS tainted_slots
FROM lineitem GROUP BY 1, 2""",
    "call_paths": _PRED + """,
w(node, last, dist, path) AS (
  SELECT node, node, dist, CAST(node AS VARCHAR) FROM p
  UNION ALL SELECT w.node, p.pred, w.dist - 1, w.path || '>' || CAST(p.pred AS VARCHAR) FROM w JOIN p ON p.node = w.last WHERE w.dist > 0)
SELECT node, path FROM w WHERE dist = 0""",
    "package_chains": """
WITH n AS (SELECT 'r' || n_regionkey AS r, 'n' || n_nationkey AS n FROM nation WHERE n_regionkey < 2),
u AS (SELECT 'n' || c_nationkey AS n, 'c' || c_custkey AS x FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)
SELECT 'r' || r_regionkey AS node, 'r' || r_regionkey AS chain FROM region WHERE r_regionkey < 2
UNION ALL SELECT n, r || '>' || n FROM n
UNION ALL SELECT x, r || '>' || n || '>' || x FROM n JOIN u USING (n)""",
    "handoff_spread": """
WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS node, role, length(text) > 1200 AS schema FROM conversations),
e AS (SELECT a.node AS caller, b.node AS callee FROM t a JOIN t b ON b.node = a.node + 1 WHERE NOT a.schema AND NOT b.schema),
r(node, dist) AS (SELECT node, 0 FROM t WHERE role = 'system' UNION SELECT e.callee, r.dist + 1 FROM r JOIN e ON e.caller = r.node)
SELECT node, CAST(min(dist) AS INT) AS dist FROM r GROUP BY node""",
    "summary_fixpoint": "WITH RECURSIVE" + _EDGES + """,
r(node, brand) AS (
  SELECT p_partkey * 2 + 1, p_brand FROM part WHERE p_size = 1
  UNION SELECT e.caller, r.brand FROM r JOIN edges e ON e.callee = r.node)
SELECT node, string_agg(DISTINCT brand, ',' ORDER BY brand) AS brands FROM r GROUP BY node""",
    "cross_file_findings": _FOUND + " SELECT * FROM found",
    "merged_directions": _FOUND + """
SELECT caller, callee, max(direction) AS direction, arg_max(depth, direction) AS depth, max(confidence) AS confidence FROM found GROUP BY 1, 2""",
}
