"""Parameter summaries and walks over order lines, read as the statements and calls of functions.

An order is a function with the parameters p0, p1 and p2. A line of return flag A moves a value from one name to another, one
of flag R calls the order with the line's part number, handing one name over and taking the result in another; the rest
return a value (line status O) or end in a sink. Lines without tax clean what they move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.operators import origins

NAMES = ("p0", "p1", "p2", "v0", "v1", "v2", "v3")
#: Calls, one within the other, that a walk looks into.
HOPS = 6


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.element_at(F.array(*map(F.lit, NAMES)), (F.col(c) % len(NAMES) + 1).cast("int"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(
        F.col("l_orderkey").alias("fn"), F.col("l_linenumber").alias("call"), F.col("l_partkey").alias("callee"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        name("l_partkey").alias("src"), name("l_suppkey").alias("dst"), F.concat(F.lit("p"), (F.col("l_linenumber") % 3).cast("string")).alias("slot"), "l_tax", "l_discount",
    )


def _walk(spark: SparkSession, sf_dir: str, seeds: bool, most: int | None) -> DataFrame:
    lines = _lines(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    # A pending order's first parameter is a number by its annotation.
    slots = orders.select(F.col("o_orderkey").alias("fn"), F.explode(F.when(F.col("o_orderstatus") == "P", F.array(F.lit("p1"), F.lit("p2"))).otherwise(F.array(*map(F.lit, NAMES[:3])))).alias("origin"))
    start = slots.withColumns({"node": F.col("origin"), "seed": F.lit(False)})
    if seeds:
        outside = lines.filter("flag = 'A' and l_discount >= 0.09").select("fn", F.concat_ws(":", F.lit("s"), "fn", "call").alias("origin"), F.col("src").alias("node"), F.lit(True).alias("seed"))
        start = start.unionByName(outside)
    moves = lines.filter("flag = 'A' and l_tax > 0").select("fn", "src", "dst")
    exits = lines.filter("flag not in ('A', 'R')").select("fn", "src", F.when(F.col("status") == "O", "@return").otherwise(F.concat_ws(":", F.lit("@sink"), "fn", "call") if seeds else F.lit("@sink")).alias("dst"))
    calls = lines.filter("flag = 'R'")
    return origins.walk(start, moves.unionByName(exits), calls.select("fn", "call", "callee", "slot", "src"), calls.select("fn", "call", "callee", "dst"), most)


def parameter_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parameters of each order reach a sink or its return, over all calls. Orders without a clerk's priority aren't summarised."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    functions = orders.select(F.col("o_orderkey").alias("fn"), (F.col("o_orderpriority") != "4-NOT SPECIFIED").alias("summarised"))
    out = origins.parameter_summaries(functions, _walk(spark, sf_dir, False, None))
    return out.select("fn", F.array_join("sink_params", ",").alias("sink_params"), F.array_join("return_params", ",").alias("return_params"))


def origin_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values from outside that reach a sink over calls, at most HOPS of them one within the other."""
    return origins.seed_flows(_walk(spark, sf_dir, True, HOPS))


def _facts(seeds: bool) -> str:
    name = "['" + "', '".join(NAMES) + "'][{} % 7 + 1]"
    sink = "'@sink:' || fn || ':' || call" if seeds else "'@sink'"
    outside = "UNION ALL SELECT fn, 's:' || fn || ':' || call, src, 0 FROM l WHERE flag = 'A' AND discount >= 0.09" if seeds else ""
    return f"""
WITH RECURSIVE l AS (
  SELECT l_orderkey AS fn, l_linenumber AS call, l_partkey AS callee, l_returnflag AS flag, l_linestatus AS status, {name.format("l_partkey")} AS src,
    {name.format("l_suppkey")} AS dst, 'p' || (l_linenumber % 3) AS slot, l_tax AS tax, l_discount AS discount FROM lineitem),
m AS (
  SELECT DISTINCT fn, src, dst FROM l WHERE flag = 'A' AND tax > 0
  UNION SELECT fn, src, CASE WHEN status = 'O' THEN '@return' ELSE {sink} END FROM l WHERE flag NOT IN ('A', 'R')),
args AS (SELECT DISTINCT fn, call, callee, slot, src FROM l WHERE flag = 'R'),
res AS (SELECT DISTINCT fn, call, callee, dst FROM l WHERE flag = 'R'),
k AS (SELECT DISTINCT a.fn, a.callee, a.slot, a.src, r.dst FROM args a LEFT JOIN res r ON r.fn = a.fn AND r.call = a.call),
r(fn, origin, node, level) USING KEY (fn, origin, node) AS (
  SELECT DISTINCT * FROM (
    SELECT o_orderkey, p, p, 0 FROM orders, (VALUES ('p0'), ('p1'), ('p2')) v(p) WHERE NOT (o_orderstatus = 'P' AND p = 'p0') {outside})
  UNION
  SELECT c.fn, c.origin, c.node, min(c.level) FROM (
    SELECT m.fn, r.origin, m.dst AS node, r.level FROM r JOIN m ON m.fn = r.fn AND m.src = r.node
    UNION ALL
    SELECT k.fn, r.origin, CASE WHEN x.node = '@return' THEN k.dst ELSE x.node END, greatest(r.level, x.level + 1)
    FROM r JOIN k ON k.fn = r.fn AND k.src = r.node JOIN recurring.r x ON x.fn = k.callee AND x.origin = k.slot WHERE x.node[1] = '@'
    UNION ALL
    SELECT k.fn, y.origin, CASE WHEN r.node = '@return' THEN k.dst ELSE r.node END, greatest(y.level, r.level + 1)
    FROM r JOIN k ON k.callee = r.fn AND k.slot = r.origin JOIN recurring.r y ON y.fn = k.fn AND y.node = k.src WHERE r.node[1] = '@'
    UNION ALL
    SELECT res.fn, r.origin, res.dst, r.level + 1 FROM r JOIN res ON res.callee = r.fn WHERE r.node = '@return' AND r.origin[1] = 's') c
  LEFT JOIN recurring.r old ON old.fn = c.fn AND old.origin = c.origin AND old.node = c.node
  WHERE c.node IS NOT NULL AND (old.node IS NULL OR old.level > c.level) GROUP BY 1, 2, 3)"""


QUERIES = {f.__name__: f for f in (parameter_summaries, origin_flows)}
ORACLES = {
    "parameter_summaries": _facts(False) + """,
g AS (
  SELECT fn, coalesce(string_agg(DISTINCT CASE WHEN node <> '@return' THEN origin END, ',' ORDER BY CASE WHEN node <> '@return' THEN origin END), '') AS s,
    coalesce(string_agg(DISTINCT CASE WHEN node = '@return' THEN origin END, ',' ORDER BY CASE WHEN node = '@return' THEN origin END), '') AS t FROM r WHERE node[1] = '@' GROUP BY fn)
SELECT o_orderkey AS fn, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN coalesce(s, '') END AS sink_params, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN coalesce(t, '') END AS return_params
FROM orders LEFT JOIN g ON g.fn = o_orderkey""",
    "origin_flows": _facts(True) + f"""
SELECT origin AS seed, node[2:] AS sink, CAST(min(level) + 1 AS INT) AS hops, arg_min(fn, struct_pack(level := level, fn := fn)) AS fn
FROM r WHERE origin[1] = 's' AND node[1] = '@' AND node <> '@return' AND level BETWEEN 1 AND {HOPS} GROUP BY 1, 2""",
}
