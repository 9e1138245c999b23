"""Where values come from, across functions: parameter summaries and walks with origin sets.

Facts are rows (fn, origin, node): a value with this origin can be in this node of the function. An origin is one of the
function's own parameters (a slot) or a seed, a value from outside. Nodes are local names, and exits, whose names begin
with @: ``@return``, and a sink, for example ``@sink`` or ``@sink 17``. Moves are the def-use edges between nodes.

A call adds edges of its own once something is known of its callee. If a parameter reaches the callee's return, the argument
goes on to the call's target; if it reaches a sink, the argument reaches that sink; a seed that the callee returns is in the
target. The level of a fact is the number of calls, one within the other, that it takes to show it: of all ways to a node the
least greatest level of an edge. Facts of a function rest on its own edges alone, so they are found where these lie sorted; what
goes over calls comes level by level, and only functions that are called take part in that.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.operators.graph import Fronts
from sievekit.operators.materialise import cut

FACT = ["fn", "origin", "node"]
#: Facts that a task hands on at once.
BATCH = 20_000


def _rows(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Edges (fn, src, dst, level) and first facts (fn, origin, node, seed, level) as rows of one table, edges first where sorted."""
    named = lambda df, a, b, seed, start: df.select("fn", F.lit(start).alias("start"), seed.alias("seed"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), F.col("level").cast("int").alias("level"))
    return named(edges, "src", "dst", F.lit(False), False).unionByName(named(starts, "origin", "node", F.col("seed"), True)).dropna()


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of each function, whose rows come one after the other, its edges first. One function's edges and one origin's facts are held."""
    out: list[list] = [[], [], [], [], []]
    kind, fn, edges, key, levels = None, None, {}, None, {}

    def spread() -> None:
        heap = sorted((level, node) for node, level in levels.items())
        while heap:
            level, node = heappop(heap)
            if levels[node] < level:
                continue
            for after, own in edges.get(node, ()):
                reached = own if own > level else level
                if reached < levels.get(after, reached + 1):
                    levels[after] = reached
                    heappush(heap, (reached, after))
        n = len(levels)
        for column, values in zip(out, ([fn] * n, [key[1]] * n, levels, [key[0]] * n, levels.values()), strict=True):
            column.extend(values)

    def made() -> pa.RecordBatch:
        types = (kind, pa.string(), pa.string(), pa.bool_(), pa.int32())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[*FACT, "seed", "level"])
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        kind = batch.schema.field("fn").type
        for f, start, seed, a, b, level in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is not None and (f != fn or (seed, a) != key):
                spread()
                key, levels = None, {}
                if len(out[0]) >= BATCH:
                    yield made()
            if f != fn:
                fn, edges = f, {}
            if not start:
                edges.setdefault(a, []).append((b, level))
            else:
                key = (seed, a)
                levels[b] = min(level, levels.get(b, level))
    if key is not None:
        spread()
    if out[0]:
        yield made()


def _closed(rows: DataFrame) -> DataFrame:
    """All facts that follow within functions from ``_rows``, each with its least level."""
    kind = rows.schema["fn"].dataType.simpleString()
    # By a value of its own: a deal by fn that a join before it has made already would be left out, and the join may then be read where it lies.
    dealt = rows.repartition(F.xxhash64("fn")).sortWithinPartitions("fn", "start", "seed", "a")
    return dealt.mapInArrow(_facts, f"fn {kind}, origin string, node string, seed boolean, level int")


def _over_calls(exits: DataFrame, bound: DataFrame, results: DataFrame) -> DataFrame:
    """What the calls' functions get to know from their callees' exits, one level on."""
    exits = exits.select(F.col("fn").alias("callee"), F.col("origin").alias("slot"), "node", "seed", (F.col("level") + 1).alias("level"))
    shown = exits.filter("not seed").join(bound, ["callee", "slot"])
    shown = shown.select("fn", "src", F.when(F.col("node") == "@return", F.col("dst")).otherwise(F.col("node")).alias("dst"), "level")
    handed = exits.filter("seed and node = '@return'").join(results, "callee").select("fn", F.col("slot").alias("origin"), F.col("dst").alias("node"), "seed", "level")
    return _rows(shown, handed).groupBy("fn", "start", "seed", "a", "b").agg(F.min("level").alias("level"))


def walk(origins: DataFrame, moves: DataFrame, arguments: DataFrame, results: DataFrame, most: int | None = None) -> DataFrame:
    """All facts, as fn, origin, node, ``seed`` and ``level``.

    origins: fn, origin, node, seed (boolean; parameters' origins are their slots); moves: fn, src, dst; arguments: fn, call,
    callee, slot, src; results: fn, call, callee, dst. ``most``: the greatest level; None: as many as there are. Rows with
    NULLs in these columns take part in nothing. Recursive calls end where nothing new is found. The facts of the last level
    aren't written: who reads them more than once cuts them.
    """
    arguments = arguments.select("fn", "call", "callee", "slot", "src")
    results = cut(results.select("fn", "call", "callee", "dst").distinct())
    bound = cut(arguments.join(results.drop("callee"), ["fn", "call"], "left").select("fn", "callee", "slot", "src", "dst").distinct())
    own = _rows(moves.withColumn("level", F.lit(0)), origins.withColumn("level", F.lit(0)))
    called = cut(bound.select(F.col("callee").alias("fn")).unionByName(results.select(F.col("callee").alias("fn"))).dropna().distinct())
    inside = lambda df: cut(df.join(called, "fn", "left_semi"))
    news = inside(own)
    held, inner, inner_results = Fronts(news), inside(bound), inside(results)
    known: Fronts | None = None
    level = 0
    while level != most:
        exits = cut(_closed(news).filter(F.col("node").startswith("@") & (F.col("level") == level)))
        if exits.isEmpty():
            break
        if known is None:
            known = Fronts(exits)
        else:
            known.add(exits)
        level += 1
        if level != most:
            more = cut(_over_calls(exits, inner, inner_results))
            held.add(more)
            news = held.all().join(more.select("fn").distinct(), "fn", "left_semi")
    return _closed(own if known is None else own.unionByName(_over_calls(known.all(), bound, results)))


def parameter_summaries(functions: DataFrame, facts: DataFrame) -> DataFrame:
    """``sink_params`` and ``return_params`` of each function: the slots whose values get there, sorted.

    functions: fn, summarised (boolean). Both are empty where nothing gets there, and NULL for functions that weren't summarised.
    """
    slots = facts.filter("not seed and node like '@%'").select("fn", "origin", (F.col("node") == "@return").alias("back")).distinct()
    slots = slots.groupBy("fn").agg(
        F.array_sort(F.collect_list(F.when(~F.col("back"), F.col("origin")))).alias("_sink"), F.array_sort(F.collect_list(F.when(F.col("back"), F.col("origin")))).alias("_return")
    )
    none = F.array().cast("array<string>")
    of = lambda name: F.when(F.col("summarised"), F.coalesce(name, none))
    return functions.join(slots, "fn", "left").select(*functions.columns, of("_sink").alias("sink_params"), of("_return").alias("return_params"))


def seed_flows(facts: DataFrame) -> DataFrame:
    """One row for each seed and sink that meet across a call: seed, sink, ``hops`` (functions on the way), ``fn`` (where both are known; of several the one with the fewest hops, then the smallest).

    A seed that reaches a sink of its own function without a call is the business of a search within functions.
    """
    rows = facts.filter("seed and level > 0 and node like '@%' and node != '@return'")
    best = rows.groupBy(F.col("origin").alias("seed"), F.expr("substring(node, 2)").alias("sink")).agg(F.min(F.struct("level", "fn")).alias("_b"))
    return best.select("seed", "sink", (F.col("_b.level") + 1).alias("hops"), F.col("_b.fn").alias("fn"))
