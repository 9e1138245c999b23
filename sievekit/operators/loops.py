"""Strongly connected components on Spark, and dispatch through registries that feeds back into itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sievekit.operators.materialise import stored

#: Nodes are bypassed as long as this takes away this share of the edges; what it leaves is labelled.
WORTH_BYPASSING = 0.1


def strong_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node in ``edges`` (caller, callee).

    0. Nodes that call each other are in one component, so what such pairs connect is merged into one node first.
    1. Nodes that nothing enters or leaves go. Others go if edges from each node before them to each node behind them are no
       more than their own edges: these replace them, so who reaches whom stays the same among the rest, and the number of
       edges never grows. Of neighbours only one goes in a round. Long ways and circles shrink to a core of few steps.
    2. In the core each node takes the smallest label that reaches it and the smallest that it reaches, both at once. Where these
       are the same, it is in that label's component; else only edges between nodes with the same two labels can be in a
       component. These start again at 1. Labels are numbers mixed one to one, so that no order of the nodes is a bad one.
    3. Nodes that have gone return, last ones first: into the component that one node before and one behind have in common; merged ones at last.

    Rounds of 1 and 3 and steps of 2 grow with the logarithm of the table where ways in the core do. Only labels that have
    changed are sent on, and minima are taken map-side.
    """
    pairs = stored(edges.select("caller", "callee").dropna().distinct())
    numbers, left = _numbered(pairs)
    found = _circles(left.filter("caller != callee"))
    labelled = stored(numbers.join(found, "id", "left").select("node", F.coalesce("label", _mixed("id")).alias("label")))
    least = labelled.groupBy("label").agg(F.min("node").alias("component"))
    return labelled.join(least, "label").select("node", "component")


def _numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of ``pairs`` (``node``) with a number each (``id``), and the pairs in these numbers."""
    names = stored(pairs.select(F.col("caller").alias("node")).unionByName(pairs.select(F.col("callee").alias("node"))).distinct())
    if names.schema["node"].dataType == LongType():
        return names.withColumn("id", F.col("node")), pairs
    numbers = stored(names.withColumn("id", F.monotonically_increasing_id()))
    of = lambda end: numbers.select(F.col("node").alias(end), F.col("id").alias(f"_{end}"))
    left = pairs.join(of("caller"), "caller").join(of("callee"), "callee")
    return numbers, left.select(F.col("_caller").alias("caller"), F.col("_callee").alias("callee"))


def _called_callers(edges: DataFrame) -> DataFrame:
    """Edges whose caller is called itself: no other can be in a circle. Most go here before they are made distinct."""
    return edges.join(edges.select(F.col("callee").alias("caller")).distinct(), "caller", "left_semi")


def _members(pairs: DataFrame) -> DataFrame:
    """``node`` and ``label`` of every node that is in a component with another one (of others only some). pairs: caller, callee, of any kind, no node with itself."""
    if pairs.schema["caller"].dataType == LongType():
        return _circles(pairs).withColumnRenamed("id", "node")
    numbers, numbered = _numbered(stored(_called_callers(pairs).distinct()))
    return stored(numbers.join(_circles(numbered), "id").select("node", "label"))


def _circles(edges: DataFrame) -> DataFrame:
    """``id`` and ``label`` of every node that is in a component with another one (of others only some). edges: caller, callee, in numbers, no node with itself."""
    merged, left = _merged(edges)
    found = _core_circles(left)
    # A merged node's label is that of the node it has gone into, or this one's own.
    of = found.select(F.col("id").alias("into"), "label")
    back = merged.join(of, "into", "left").select("id", F.coalesce("label", _mixed("into")).alias("label"))
    return stored(back.unionByName(found.join(merged, "id", "left_anti").select("id", "label")))


def _merged(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that are called by one that they call (``id``) with the node that they are merged ``into``, and the distinct edges that this leaves."""
    least, most = F.least("caller", "callee").alias("a"), F.greatest("caller", "callee").alias("b")
    pairs = edges.groupBy(least, most).agg(F.bool_or(F.col("caller") < F.col("callee")).alias("up"), F.bool_or(F.col("caller") > F.col("callee")).alias("down"))
    pairs = stored(pairs)
    into = _joined(pairs.filter("up and down").select("a", "b"))
    single = pairs.filter("not (up and down)").select(F.when(F.col("up"), F.col("a")).otherwise(F.col("b")).alias("caller"), F.when(F.col("up"), F.col("b")).otherwise(F.col("a")).alias("callee"))
    # Nodes that call: merged ones, and callers. Most edges end elsewhere.
    calling = into.unionByName(single.select(F.col("caller").alias("id"), F.lit(None).cast("long").alias("into"))).groupBy("id").agg(F.max("into").alias("into"))
    left = single.join(calling.select(F.col("id").alias("callee"), F.coalesce("into", "id").alias("_callee")), "callee").select("caller", "_callee")
    left = left.join(into.select(F.col("id").alias("caller"), F.col("into").alias("_caller")), "caller", "left").select(F.coalesce("_caller", "caller").alias("caller"), F.col("_callee").alias("callee"))
    return into, stored(_called_callers(stored(left.filter("caller != callee").distinct())))


def _joined(pairs: DataFrame) -> DataFrame:
    """``id`` of each node of ``pairs`` (a < b, distinct) and ``into``, one node of those that pairs connect it with.

    Of nodes that are the greater one in all their pairs each goes into its least partner at once, which the others meet: of pairs between
    two kinds of nodes this leaves one kind. Then each node takes the one of lowest rank of itself and its partners, with ranks that are new
    in each round, and pairs go on between what was taken.
    """
    between = stored(pairs.select("a").distinct().join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_semi"))
    of_tops = pairs.join(between.withColumnRenamed("a", "b"), "b", "left_anti")
    tops = stored(of_tops.groupBy("b").agg(F.min("a").alias("into")))
    met = of_tops.join(tops, "b").filter("a != into").select(F.col("into").alias("a"), F.col("a").alias("b"))
    left = stored(met.unionByName(pairs.join(between.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")).distinct())
    taken: list[DataFrame] = []
    while not left.isEmpty():
        rank = lambda x: F.xxhash64(F.lit(len(taken)), x)  # noqa: B023, E731
        ends = left.select(F.col("a").alias("id"), F.struct(rank("b").alias("rank"), F.col("b").alias("into")).alias("other"))
        ends = ends.unionByName(left.select(F.col("b").alias("id"), F.struct(rank("a").alias("rank"), F.col("a").alias("into")).alias("other")))
        own = F.struct(rank("id").alias("rank"), F.col("id").alias("into"))
        took = stored(ends.groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("other", own)["into"].alias("into")))
        taken.append(took)
        of = lambda end: took.select(F.col("id").alias(end), F.col("into").alias(f"_{end}"))  # noqa: B023, E731
        left = left.join(of("a"), "a").join(of("b"), "b").filter("_a != _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        left = stored(left.distinct())
    into = tops.select(F.col("b").alias("id"), "into").limit(0)
    for took in reversed(taken):
        into = stored(took.join(into.select(F.col("id").alias("into"), F.col("into").alias("_into")), "into", "left").select("id", F.coalesce("_into", "into").alias("into")))
    all_ = tops.select(F.col("b").alias("id"), "into").unionByName(pairs.select(F.col("a").alias("id"), F.col("a").alias("into")).distinct())
    return stored(all_.join(into.select(F.col("id").alias("into"), F.col("into").alias("_into")), "into", "left").select("id", F.coalesce("_into", "into").alias("into")))


def _core_circles(left: DataFrame) -> DataFrame:
    """``_circles`` of distinct edges, by steps 1 to 3."""
    gone: list[DataFrame] = []
    found = left.select(F.col("caller").alias("id"), F.col("caller").alias("label")).limit(0)
    many = left.count()
    while many:
        before = many
        left, between = _bypassed(left, len(gone))
        gone.append(between)
        many = left.count()
        if not many or many < (1 - WORTH_BYPASSING) * before:
            continue
        labels = _labels(left)
        found = stored(found.unionByName(labels.filter("first = last").select("id", F.col("first").alias("label"))))
        own = labels.filter("first != last")
        of = lambda end: own.select(F.col("id").alias(end), "first", "last")
        left = stored(left.join(of("caller"), "caller").join(of("callee"), ["callee", "first", "last"]).select("caller", "callee"))
        many = left.count()
    for between in reversed(gone):
        # Early rounds take the most nodes, so what has returned before is written again for a part of the last ones.
        found = stored(found.unionByName(_returned(between, found)))
    return found


def _mixed(column: str) -> Column:
    """A number's label: one to one, by shifts."""
    x = F.col(column)
    for _ in range(2):
        x = x.bitwiseXOR(F.shiftleft(x, 13))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
        x = x.bitwiseXOR(F.shiftleft(x, 17))
    return x


def _bypassed(edges: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The edges that a round leaves, and of each node that was bypassed (``id``) the pairs of nodes ``x`` before and ``y`` behind it."""
    rank = lambda end: F.xxhash64(F.lit(seed), end)
    ends = edges.select(F.col("callee").alias("id"), F.lit(1).alias("ins"), F.lit(0).alias("outs"), rank("caller").alias("rank"))
    ends = ends.unionByName(edges.select(F.col("caller").alias("id"), F.lit(0).alias("ins"), F.lit(1).alias("outs"), rank("callee").alias("rank")))
    ends = ends.groupBy("id").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs"), F.min("rank").alias("rank"))
    # In doubles: a product of two numbers of edges may be larger than a long.
    few = F.col("ins").cast("double") * F.col("outs") <= F.col("ins") + F.col("outs")
    dead = (F.col("ins") == 0) | (F.col("outs") == 0)
    leaving = stored(ends.filter(dead | (few & (rank("id") < F.col("rank")))).select("id", dead.alias("dead")))
    dead, chosen = (leaving.filter(c).select("id") for c in ("dead", "not dead"))
    into = edges.join(chosen.withColumnRenamed("id", "callee"), "callee").join(dead.withColumnRenamed("id", "caller"), "caller", "left_anti")
    out = edges.join(chosen.withColumnRenamed("id", "caller"), "caller").join(dead.withColumnRenamed("id", "callee"), "callee", "left_anti")
    between = into.select(F.col("callee").alias("id"), F.col("caller").alias("x")).join(out.select(F.col("caller").alias("id"), F.col("callee").alias("y")), "id")
    between = stored(between.select("id", "x", "y"))
    kept = edges.join(leaving.select(F.col("id").alias("caller")), "caller", "left_anti").join(leaving.select(F.col("id").alias("callee")), "callee", "left_anti")
    new = between.filter("x != y").select(F.col("x").alias("caller"), F.col("y").alias("callee"))
    return stored(kept.select("caller", "callee").unionByName(new).distinct()), between


def _labels(edges: DataFrame) -> DataFrame:
    """id, ``first`` (the smallest label that reaches it) and ``last`` (the smallest that it reaches)."""
    nodes = edges.select(F.col("caller").alias("id")).unionByName(edges.select(F.col("callee").alias("id"))).distinct()
    labels = stored(nodes.select("id", _mixed("id").alias("first"), _mixed("id").alias("last"), F.lit(True).alias("_new")))
    while True:
        news = labels.filter("_new")
        none = F.lit(None).cast("long")
        down = edges.join(news.select(F.col("id").alias("caller"), "first"), "caller").select(F.col("callee").alias("id"), F.col("first").alias("_first"), none.alias("_last"))
        up = edges.join(news.select(F.col("id").alias("callee"), "last"), "callee").select(F.col("caller").alias("id"), none.alias("_first"), F.col("last").alias("_last"))
        sent = down.unionByName(up).groupBy("id").agg(F.min("_first").alias("_first"), F.min("_last").alias("_last"))
        less = F.coalesce(F.col("_first") < F.col("first"), F.lit(False)) | F.coalesce(F.col("_last") < F.col("last"), F.lit(False))
        labels = stored(labels.join(sent, "id", "left").select("id", F.least("first", "_first").alias("first"), F.least("last", "_last").alias("last"), less.alias("_new")))
        if labels.filter("_new").isEmpty():
            return labels.drop("_new")


def _returned(between: DataFrame, found: DataFrame) -> DataFrame:
    """id and label of the bypassed nodes that are in a component, and of the others that these make one; a node without one so far has its own label."""
    for end in ("x", "y"):
        of = found.select(F.col("id").alias(end), F.col("label").alias(f"_{end}"))
        between = between.join(of, end, "left")
    alone = between.filter("x = y and _x is null").select(F.col("x").alias("id"), _mixed("x").alias("label")).distinct()
    labels = between.select("id", F.coalesce("_x", _mixed("x")).alias("_x"), F.coalesce("_y", _mixed("y")).alias("_y"))
    return labels.filter("_x = _y").groupBy("id").agg(F.min("_x").alias("label")).unionByName(alone)


def feedback_loops(edges: DataFrame) -> DataFrame:
    """Components that are loops: ``component``, ``members``, ``inner_edges``; more than one node, or a node that calls itself.

    Nodes outside of all loops are neither numbered nor joined: only pairs whose caller is called are written at all.
    """
    pairs = edges.select("caller", "callee").dropna()
    itself = stored(pairs.filter("caller = callee").select(F.col("caller").alias("node")).distinct())
    pairs = stored(_called_callers(pairs.filter("caller != callee")).distinct())
    members = _members(pairs)
    of = lambda end: members.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
    inner = pairs.join(of("caller"), "caller").join(of("callee"), "callee").filter("_caller = _callee").groupBy(F.col("_caller").alias("label")).agg(F.count("*").alias("_inner"))
    loops = members.join(itself.withColumn("_self", F.lit(1)), "node", "left").groupBy("label")
    loops = loops.agg(F.min("node").alias("component"), F.count("*").alias("members"), F.count("_self").alias("_self"))
    loops = loops.join(inner, "label", "left").select("component", "members", (F.coalesce("_inner", F.lit(0)) + F.col("_self")).alias("inner_edges")).filter("inner_edges > 0")
    alone = itself.join(members, "node", "left_anti").select(F.col("node").alias("component"), F.lit(1).cast("long").alias("members"), F.lit(1).cast("long").alias("inner_edges"))
    return loops.unionByName(alone)


#: Weaknesses of a dispatch: any, and of one capability beside it.
DISPATCH_CWE, CAPABILITY_CWE = 284, {"unpinned package supply chain execution": 829}


def capability_findings(dispatches: DataFrame, imports: DataFrame, registries: DataFrame, capabilities: DataFrame, edges: DataFrame) -> DataFrame:
    """Tools that a model selects from a registry, with what the registry exposes.

    dispatches: file, fn, line, registry (its local name), model_line; imports: file, local_name, target_file, target_name;
    registries: file, registry, place, function; capabilities: file, function, capability, line; edges: caller, callee,
    as ``file:function``. Where edges have other keys (numbers are quicker), dispatches, registries and capabilities bring the key of
    their function as ``node``. A registry is the imported one, else the file's own. Of each capability the first function that has
    it counts. One row for each dispatch into a registry with capabilities: its columns and ``registry_file``,
    ``capabilities`` (sorted), ``sink_function``, ``sink_line`` (of the first capability), ``cwe`` and ``feedback_loop``: is
    a function that the registry holds in one loop with the dispatching one?

    What is known of a function (capabilities, component) meets the registries once, what is known of a registry the dispatches once.
    """
    keyed = lambda rows, *names: rows if "node" in rows.columns else rows.withColumn("node", F.concat_ws(":", *names))
    registry = ["registry_file", "_registry"]
    pairs = edges.select("caller", "callee").dropna()
    members = _members(pairs.filter("caller != callee")).select("node", F.col("label").alias("_label"))
    able = keyed(capabilities, "file", "function").groupBy("node").agg(F.collect_list(F.struct("file", "function", "capability", F.col("line").alias("_line"))).alias("_able"))
    held = keyed(registries, "file", "function").select("node", F.col("file").alias("registry_file"), F.col("registry").alias("_registry"), "place", "function")
    held = stored(held.join(able.join(members, "node", "full_outer"), "node"))

    first = held.select(*registry, "place", "function", F.explode("_able").alias("_a")).filter("_a.file = registry_file and _a.function = function")
    first = first.groupBy(*registry, F.col("_a.capability").alias("capability"))
    first = first.agg(F.min(F.struct("place", F.col("_a._line").alias("_line"), "function")).alias("_f"))
    exposed = first.groupBy(*registry).agg(F.sort_array(F.collect_list("capability")).alias("capabilities"), F.min(F.struct("capability", "_f")).alias("_f"))
    exposed = exposed.select(*registry, "capabilities", F.col("_f._f.function").alias("sink_function"), F.col("_f._f._line").alias("sink_line"))
    known = imports.select("file", F.col("local_name").alias("registry"), F.coalesce("target_file", "file").alias("registry_file"), F.coalesce("target_name", "local_name").alias("_registry"))
    own = exposed.withColumns({"file": F.col("registry_file"), "registry": F.col("_registry")}).join(known.select("file", "registry").distinct(), ["file", "registry"], "left_anti")
    named = known.join(exposed, registry).unionByName(own)

    # Of a registry and a component one row: any tool but the dispatching function itself will do, and that one too if it calls itself.
    alike = held.filter("_label is not null").groupBy(*registry, "_label").agg(F.min("node").alias("_least"), F.max("node").alias("_most"))
    rows = keyed(dispatches, "file", "fn").join(members, "node", "left").join(named, ["file", "registry"]).join(alike, [*registry, "_label"], "left")
    looped = F.coalesce((F.col("_least") != F.col("node")) | (F.col("_most") != F.col("node")), F.lit(False))
    itself = stored(pairs.filter("caller = callee").select(F.col("caller").alias("node")).distinct())
    if not itself.isEmpty():
        itself = keyed(registries, "file", "function").join(itself, "node").select("node", F.col("file").alias("registry_file"), F.col("registry").alias("_registry"), F.lit(True).alias("_self")).distinct()
        rows = rows.join(itself, ["node", *registry], "left")
        looped = looped | F.coalesce("_self", F.lit(False))
    more = [F.when(F.array_contains("capabilities", c), F.array(F.lit(n))).otherwise(F.array().cast("array<int>")) for c, n in CAPABILITY_CWE.items()]
    return rows.select(
        *(c for c in dispatches.columns if c != "node"), "registry_file", "capabilities", "sink_function", "sink_line",
        F.concat(F.array(F.lit(DISPATCH_CWE)), *more).alias("cwe"), looped.alias("feedback_loop"),
    )
