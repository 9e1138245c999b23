"""Call-graph queries: layers, closures, relays, paths, fixpoints.

Edges are ``caller`` -> ``callee``. Each round joins only the newest layer with the edges and drops what was
reached before, so a node is expanded once and cycles end. Rounds stop when the layer is empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.operators.findings import hop_confidence
from sievekit.operators.joins import partners
from sievekit.operators.materialise import SENT, cut, side, stored


#: Fronts that are kept apart until they are written as one.
FRONTS = 16


class Fronts:
    """Rows found so far, front by front; each is written once, and now and then all are written as one."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, front: DataFrame) -> None:
        self.parts.append(front)
        if len(self.parts) > FRONTS:
            self.parts = [stored(self.all())]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def layers(
    edges: DataFrame, seeds: DataFrame, first_edges: DataFrame | None = None, most: int | None = None, upward: bool = True, written: bool = False, known: DataFrame | None = None
) -> DataFrame:
    """Breadth-first layers from all ``seeds`` (column ``node``): node, ``dist`` (fewest hops), ``pred`` (the smallest node of the layer before), ``origin`` (the seed that ``pred`` leads to).

    ``upward`` goes from callees to callers, else from callers to callees. ``first_edges`` replaces the edges of
    the first hop. ``most``: hops at most; None: as many as there are. ``written``: the edges are stored already, so they are
    read as they are. ``known``: nodes (column ``node``) that aren't entered and aren't returned.

    Of a layer only the nodes that edges lead on from meet the edges. A table of few rows meets a larger one without a shuffle.
    """
    near, far = ("callee", "caller") if upward else ("caller", "callee")

    def pairs(e: DataFrame) -> tuple[DataFrame, DataFrame]:
        e = e.select(F.col(near).alias("_near"), F.col(far).alias("_far"))
        e = e if written else stored(e.distinct())
        return e, stored(e.select(F.col("_near").alias("node")).distinct())

    later = pairs(edges)
    first = pairs(first_edges) if first_edges is not None else later
    node_type = seeds.schema["node"].dataType
    front = stored(seeds.select("node", F.lit(0).alias("dist"), F.lit(None).cast(node_type).alias("pred"), F.col("node").alias("origin")).distinct())
    reached, hop, new = Fronts(front), 0, front.count()
    entered = new + (0 if known is None else known.count())
    while most is None or hop < most:
        hop += 1
        moves, able = first if hop == 1 else later
        leading = stored(able.join(side(front.select("node", "origin"), new), "node").select(F.col("node").alias("_near"), "origin"))
        found = moves.join(side(leading, new if new <= SENT else None), "_near").groupBy(F.col("_far").alias("node"))
        found = found.agg(F.min("_near").alias("pred"), F.min_by("origin", "_near").alias("origin"))
        before = reached.all().select("node")
        before = before if known is None else before.unionByName(known.select("node"))
        # No anti-join: the planner would do one on the edges, before they meet the few nodes that lead on.
        found = found.join(side(before.withColumn("_before", F.lit(True)), entered), "node", "left").filter("_before is null")
        front = stored(found.select("node", F.lit(hop).alias("dist"), "pred", "origin"))
        new = front.count()
        if not new:
            break
        entered += new
        reached.add(front)
    return reached.all()


def closure(edges: DataFrame, seeds: DataFrame, upward: bool = False, most: int | None = None, written: bool = False) -> DataFrame:
    """The nodes that can be reached, seeds included."""
    return layers(edges, seeds, most=most, upward=upward, written=written).select("node")


def misses_sink() -> Column:
    """Do a call's tainted arguments surely miss the callee's sink? Only if slots and summary are both known and share nothing.

    Edge columns: ``tainted_slots``, ``sink_params`` (of the callee), arrays or NULL, and ``has_args``. NULL is
    "not computed"; an empty array is "computed, nothing gets there".
    """
    known = F.col("sink_params").isNotNull() & F.col("tainted_slots").isNotNull()
    return known & ~F.coalesce(F.arrays_overlap("sink_params", "tainted_slots"), F.lit(False))


def hits_sink() -> Column:
    """Does a call hand taint to the callee's own sink? With a summary a slot has to be shown; without one any tainted argument will do."""
    shown = F.coalesce(F.arrays_overlap("sink_params", "tainted_slots"), F.lit(False))
    return F.when(F.col("sink_params").isNotNull(), shown).otherwise(passes_taint())


def passes_taint() -> Column:
    """Any tainted argument; where slots aren't known, any argument."""
    return F.when(F.col("tainted_slots").isNotNull(), F.size("tainted_slots") > 0).otherwise(F.coalesce(F.col("has_args"), F.lit(False)))


def returns_call() -> Column:
    """Does the caller return this call's result? A NULL summary says yes."""
    return F.col("returned_calls").isNull() | F.array_contains("returned_calls", F.col("callee_name"))


def edges_of_calls(calls: DataFrame) -> DataFrame:
    """One row for each caller and callee: any call with arguments, three-valued any call with taint, first line, all slots.

    ``carries_taint`` stays NULL only if no call knows; ``bool_or`` leaves out NULLs.
    """
    return calls.groupBy("caller", "callee").agg(
        F.bool_or("has_args").alias("has_args"),
        F.bool_or("carries_taint").alias("carries_taint"),
        F.min("line").alias("line"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tainted_slots")))).alias("tainted_slots"),
    )


def resolved_calls(calls: DataFrame, imports: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls with their callee's file: a known receiver first, then the qualifier's module, the imported name, the same file.

    calls: file, callee_name, qualifier, resolved_file; imports: file, local_name, target_file, kind (module or
    name); functions: file, name.
    """
    modules = imports.filter("kind = 'module'").select("file", F.col("local_name").alias("qualifier"), F.col("target_file").alias("_module_file"))
    names = imports.filter("kind = 'name'").select("file", F.col("local_name").alias("callee_name"), F.col("target_file").alias("_name_file"))
    own = functions.select("file", F.col("name").alias("callee_name"), F.col("file").alias("_own_file")).distinct()
    rows = calls.join(modules, ["file", "qualifier"], "left").join(names, ["file", "callee_name"], "left").join(own, ["file", "callee_name"], "left")
    by_name = F.when(F.col("qualifier").isNull(), F.coalesce("_name_file", "_own_file"))
    return rows.withColumn("callee_file", F.coalesce("resolved_file", "_module_file", by_name)).drop("_module_file", "_name_file", "_own_file")


#: CWE of forged log entries: real, but not what a sink usually is.
LOG_FORGING = 117
RULES = {"sink": "CF-SINK-001", "return": "CF-RETURN-001"}


def emissions(edges: DataFrame, functions: DataFrame, most: int | None = None) -> DataFrame:
    """Cross-file findings, one for each (caller, callee, direction): direction ``sink`` or ``return``, depth, severity, confidence, rule_id, sink.

    functions: node, file, has_sink, has_source, operator_only (its sources are the operator's own), sink_params,
    return_params, sink_calls, returned_calls, sink_cwe (array of int), classified (its sink has a category or a
    description). edges: caller, callee, callee_name, has_args, tainted_slots. A finding needs two files.

    sink: a caller that taint reaches hands it to a callee from which a sink is reached. return: a caller with a sink
    of its own uses a callee's tainted result, or that of a callee that returns what it is given (depth 0, where the
    first way found nothing). ``sink``: the function at the end of the chain; of a return the callee. High; medium for
    forged log entries and for an operator's own input, whose confidence is at most 0.5; low for a return from a
    callee of which nothing is known.
    """
    functions = stored(functions)
    many = functions.count()  # no table of nodes has more rows
    f = lambda end, *names: side(functions.select(F.col("node").alias(end), *(F.col(n).alias(f"{end}_{n}") for n in names)), many, "shuffle_hash")
    named = F.col("caller_sink_calls").isNull() | F.array_contains("caller_sink_calls", F.col("callee_name"))
    # What the searches ask of an edge are yes-or-no answers: they are given once, as soon as they can be, and arrays and names stay behind.
    rows = edges.join(f("caller", "file", "has_sink", "sink_calls", "returned_calls"), "caller").withColumnRenamed("caller_returned_calls", "returned_calls")
    rows = rows.select("caller", "callee", "caller_file", "caller_has_sink", (F.col("caller_has_sink") & named).alias("named"), returns_call().alias("returns"), "has_args", "tainted_slots")
    rows = rows.join(f("callee", "file", "sink_params", "return_params"), "callee").withColumnRenamed("callee_sink_params", "sink_params")
    across = F.col("caller_file") != F.col("callee_file")
    answers = {
        "passes": passes_taint(), "reaches": ~misses_sink(), "returns": F.col("returns"), "across": across, "hits": hits_sink(), "uses": across & F.col("named"),
        "through": across & F.col("caller_has_sink") & F.arrays_overlap("tainted_slots", "callee_return_params"),
    }
    gated = stored(rows.select("caller", "callee", *(F.coalesce(x, F.lit(False)).alias(n) for n, x in answers.items())))
    passing = gated.filter("passes")
    sinks = functions.filter("has_sink").select("node")
    sources = functions.filter("has_source")
    to_sink = layers(passing, sinks, first_edges=gated.filter("reaches"), most=most, written=True)
    returning = layers(gated.filter("returns"), sources.select("node"), most=most, written=True)
    from_remote = closure(passing, sources.filter("not operator_only").select("node"), upward=False, most=most, written=True)
    own_input = sources.select("node").join(side(from_remote, many), "node", "left_anti")
    if most is None:
        # Whatever the remote sources reach leads to nothing new.
        from_source = from_remote.unionByName(layers(passing, own_input, upward=False, written=True, known=from_remote).select("node"))
    else:
        from_source = closure(passing, sources.select("node"), upward=False, most=most, written=True)

    hit = gated.filter("across and (hits or passes)").join(side(to_sink.select(F.col("node").alias("callee"), "dist", "origin"), many), "callee")
    hit = hit.filter(F.when(F.col("dist") == 0, F.col("hits")).otherwise(F.col("passes"))).join(side(from_source.select(F.col("node").alias("caller")), many), "caller", "left_semi")
    hit = hit.select("caller", "callee", F.lit("sink").alias("direction"), F.col("dist").alias("depth"), F.col("origin").alias("sink")).distinct()
    remote = from_remote.select(F.col("node").alias("caller"), F.lit(False).alias("own_input"))
    hit = hit.join(side(remote, many), "caller", "left").withColumn("own_input", F.coalesce("own_input", F.lit(True)))
    back = gated.filter("uses").join(side(returning.select(F.col("node").alias("callee"), "dist"), many), "callee")
    through = gated.filter("through")
    # Where both ways find an edge, the relayed one counts.
    back = back.select("caller", "callee", F.col("dist").alias("depth"), F.lit(0).alias("_way")).unionByName(through.select("caller", "callee", F.lit(0).alias("depth"), F.lit(1).alias("_way")))
    back = back.groupBy("caller", "callee").agg(F.min_by("depth", F.struct("_way", "depth")).alias("depth"))
    back = back.select("caller", "callee", F.lit("return").alias("direction"), "depth", F.col("callee").alias("sink"), F.lit(False).alias("own_input"))
    found = hit.unionByName(back).join(side(functions.select(F.col("node").alias("sink"), "sink_cwe", "classified"), many, "shuffle_hash"), "sink")
    unknown = (F.col("direction") == "return") & (F.size("sink_cwe") == 0) & ~F.col("classified")
    mild = F.array_contains("sink_cwe", LOG_FORGING) | F.col("own_input")
    confidence = hop_confidence(F.col("depth"), "cross-file")
    return found.select(
        "direction", "caller", "callee", "depth", "sink", F.when(unknown, "low").when(mild, "medium").otherwise("high").alias("severity"),
        F.when(F.col("own_input"), F.least(confidence, F.lit(0.5))).otherwise(confidence).alias("confidence"),
        F.when(F.col("direction") == "sink", RULES["sink"]).otherwise(RULES["return"]).alias("rule_id"),
    )


def merge_directions(found: DataFrame) -> DataFrame:
    """Of a sink and a return finding between the same two functions the sink one stays, with the greater confidence."""
    first = F.when(F.col("direction") == "sink", 0).otherwise(1)
    return found.groupBy("caller", "callee").agg(
        F.min_by("direction", first).alias("direction"), F.min_by("depth", first).alias("depth"), F.max("confidence").alias("confidence")
    )


def paths(reached: DataFrame, most: int | None = None) -> DataFrame:
    """``path`` of each node of ``layers()``: itself, its predecessor, and so on to the seed."""
    front = cut(reached.filter("dist = 0").select("node", "dist", F.array("node").alias("path")))
    done, hop = Fronts(front), 0
    while most is None or hop < most:
        hop += 1
        step = reached.filter(F.col("dist") == hop).join(front.select(F.col("node").alias("pred"), F.col("path").alias("_tail")), "pred")
        front = cut(step.select("node", "dist", F.concat(F.array("node"), "_tail").alias("path")))
        if front.isEmpty():
            break
        done.add(front)
    return done.all()


def fixpoint(state: DataFrame, key: str, edges: DataFrame, combine: Callable[[DataFrame], DataFrame], rounds: int | None = None) -> DataFrame:
    """Round-based summaries: callers of functions that changed are summed up anew until nothing changes.

    ``state``: ``key`` and ``value`` (an array of what a function's summary holds). ``combine`` turns rows
    (key, value of a callee) into rows (key, value). Values only grow, so their sizes tell what has changed, and
    the rounds end. Raises RuntimeError if ``rounds`` is given and doesn't suffice. Edges are made once, and shuffled only where
    many summaries have changed.
    """
    edges = stored(edges.select("caller", "callee"))
    state = stored(state.select(key, "value"))
    kind = state.schema["value"].dataType
    changed, done = state, 0
    while not changed.isEmpty():
        if done == rounds:
            raise RuntimeError("fixpoint: more rounds are needed")
        done += 1
        news = edges.join(side(changed.withColumnRenamed(key, "callee")), "callee").select(F.col("caller").alias(key), "value")
        news = combine(news).withColumnRenamed("value", "_more")
        joined = state.join(news, key, "full_outer")
        union = F.array_sort(F.array_union(F.coalesce("value", F.array().cast(kind)), F.coalesce("_more", F.array().cast(kind))))
        after = stored(joined.select(key, union.alias("value"), (F.size(union) > F.coalesce(F.size("value"), F.lit(0))).alias("_grew")))
        changed = stored(after.filter("_grew").select(key, "value"))
        state = after.select(key, "value")
    return state


def handoffs(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """Armed agents arm those they hand over to, unless either end has an output schema. nodes: node, armed, has_schema."""
    free = nodes.filter("not has_schema").select("node")
    open_ = edges.join(free.withColumnRenamed("node", "caller"), "caller", "left_semi").join(free.withColumnRenamed("node", "callee"), "callee", "left_semi")
    return layers(open_, nodes.filter("armed").select("node"), upward=False, most=most)


def attributed_sinks(functions: DataFrame, findings: DataFrame) -> DataFrame:
    """Of each function its earliest finding: on one line the stronger one, then the first. findings: node, line, confidence, seq, rule_id."""
    first = findings.groupBy("node").agg(F.min_by(F.struct("line", "rule_id"), F.struct("line", -F.col("confidence"), "seq")).alias("_f"))
    return functions.join(first, "node", "left").select(*functions.columns, F.col("_f.line").alias("sink_line"), F.col("_f.rule_id").alias("sink_rule_id"))


def persistent_flows(functions: DataFrame, channels: DataFrame) -> DataFrame:
    """Flows through a store, within one file too: a writer that has a source and a reader that has a sink of one key."""
    writes = channels.filter("role = 'write'").select("kind", "key", F.col("fn_id").alias("writer")).distinct()
    reads = channels.filter("role = 'read'").select("kind", "key", F.col("fn_id").alias("reader")).distinct()
    rows = writes.join(functions.filter("has_source").select(F.col("node").alias("writer")), "writer", "left_semi")
    return rows.join(reads.join(functions.filter("has_sink").select(F.col("node").alias("reader")), "reader", "left_semi"), ["kind", "key"])


def stored_flows(functions: DataFrame, channels: DataFrame) -> DataFrame:
    """``persistent_flows`` by members: each writer with a source and each reader with a sink, with how many of the other side its key has, and the first of these."""
    rows = channels.select("kind", "key", "role", "fn_id").distinct()
    able = functions.select(F.col("node").alias("fn_id"), "has_source", "has_sink")
    rows = rows.join(able, "fn_id").filter((F.col("has_source") & (F.col("role") == "write")) | (F.col("has_sink") & (F.col("role") == "read")))
    return partners(rows, ["kind", "key"])
