import random

import pytest
from pyspark.sql import functions as F

from sievekit.operators import graph, materialise


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "caller string, callee string")


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def layers(*args, **kw):
    return {r.node: (r.dist, r.pred) for r in graph.layers(*args, **kw).collect()}


def test_chain_has_hops(spark):
    assert layers(edges(spark, [("a", "b"), ("b", "c")]), seeds(spark, "c")) == {"c": (0, None), "b": (1, "c"), "a": (2, "b")}


def test_diamond_takes_the_shorter_arm_and_the_smaller_predecessor(spark):
    e = edges(spark, [("top", "x"), ("top", "y"), ("x", "s"), ("y", "s"), ("far", "top"), ("far", "z"), ("z", "zz"), ("zz", "top")])
    found = layers(e, seeds(spark, "s"))
    assert found["top"] == (2, "x")
    assert found["far"] == (3, "top")


def test_cycle_self_loop_and_unreachable(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("a", "a"), ("q", "r")])
    assert layers(e, seeds(spark, "a")) == {"a": (0, None), "b": (1, "a")}


def test_hops_can_be_limited_and_paths_built(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    assert set(layers(e, seeds(spark, "d"), most=2)) == {"d", "c", "b"}
    found = {r.node: r.path for r in graph.paths(graph.layers(e, seeds(spark, "d"))).collect()}
    assert found["a"] == ["a", "b", "c", "d"]


def test_closure_goes_forward(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("x", "a")])
    assert {r.node for r in graph.closure(e, seeds(spark, "a")).collect()} == {"a", "b", "c"}


def test_relay_gates_tell_null_from_empty(spark):
    rows = spark.createDataFrame(
        [(1, None, ["0"], True), (2, [], ["0"], True), (3, ["0"], ["0"], True), (4, ["1"], ["0"], True), (5, ["1"], None, True), (6, None, [], False)],
        "id int, sink_params array<string>, tainted_slots array<string>, has_args boolean",
    )
    assert {r.id for r in rows.filter(~graph.misses_sink()).collect()} == {1, 3, 5, 6}
    assert {r.id for r in rows.filter(graph.hits_sink()).collect()} == {1, 3}


def test_edge_summary_keeps_three_values(spark):
    calls = spark.createDataFrame(
        [("a", "b", False, None, 9, ["x"]), ("a", "b", True, False, 4, ["y"]), ("a", "c", True, None, 1, [])],
        "caller string, callee string, has_args boolean, carries_taint boolean, line int, tainted_slots array<string>",
    )
    rows = {r.callee: r for r in graph.edges_of_calls(calls).collect()}
    assert (rows["b"].has_args, rows["b"].carries_taint, rows["b"].line, rows["b"].tainted_slots) == (True, False, 4, ["x", "y"])
    assert rows["c"].carries_taint is None


def test_calls_resolve_in_order(spark):
    calls = spark.createDataFrame(
        [("f", "run", None, None), ("f", "run", "m", None), ("f", "run", "m", "typed"), ("f", "own", None, None), ("f", "none", None, None)],
        "file string, callee_name string, qualifier string, resolved_file string",
    )
    imports = spark.createDataFrame([("f", "m", "mod.py", "module"), ("f", "run", "name.py", "name")], "file string, local_name string, target_file string, kind string")
    functions = spark.createDataFrame([("f", "own")], "file string, name string")
    found = {(r.callee_name, r.qualifier, r.resolved_file): r.callee_file for r in graph.resolved_calls(calls, imports, functions).collect()}
    assert found == {("run", None, None): "name.py", ("run", "m", None): "mod.py", ("run", "m", "typed"): "typed", ("own", None, None): "f", ("none", None, None): None}


FUNCTION = (
    "node string, file string, has_sink boolean, has_source boolean, operator_only boolean, sink_params array<string>, return_params array<string>, sink_calls array<string>, "
    "returned_calls array<string>, sink_cwe array<int>, classified boolean"
)
EDGE = "caller string, callee string, callee_name string, has_args boolean, tainted_slots array<string>"


def function(node, file, sink=False, source=False, own=False, sink_params=None, return_params=None, sink_calls=None, returned_calls=None, cwe=(), classified=True):
    return node, file, sink, source, own, sink_params, return_params, sink_calls, returned_calls, list(cwe), classified


def emitted(spark, functions, edges):
    rows = graph.emissions(spark.createDataFrame(edges, EDGE), spark.createDataFrame(functions, FUNCTION)).collect()
    return {(r.direction, r.caller, r.callee): r for r in rows}


def test_emissions_need_two_files_and_a_source(spark):
    functions = [function("src", "a.py", source=True), function("mid", "b.py"), function("snk", "c.py", sink=True, sink_params=["0"], cwe=[89]), function("same", "c.py", source=True)]
    found = emitted(spark, functions, [("src", "mid", "mid", True, ["0"]), ("mid", "snk", "snk", True, ["0"]), ("src", "snk", "snk", True, ["1"]), ("same", "snk", "snk", True, ["0"])])
    assert set(found) == {("sink", "mid", "snk"), ("sink", "src", "mid")}  # slot 1 doesn't reach the sink, one file isn't two
    assert (found["sink", "mid", "snk"].depth, found["sink", "src", "mid"].depth, found["sink", "src", "mid"].sink) == (0, 1, "snk")
    assert {r.severity for r in found.values()} == {"high"} and found["sink", "src", "mid"].confidence == 0.65


def test_a_summary_unknown_relays_but_does_not_show(spark):
    # Without slots the first hop relays (nothing proves that it misses), but a known summary has to be hit for a finding.
    functions = [function("src", "a.py", source=True), function("mid", "b.py", source=True), function("snk", "c.py", sink=True, sink_params=["0"])]
    found = emitted(spark, functions, [("src", "mid", "mid", True, ["0"]), ("mid", "snk", "snk", False, None)])
    assert set(found) == {("sink", "src", "mid")}


def test_severity_and_confidence(spark):
    functions = [
        function("remote", "a.py", source=True), function("own", "b.py", source=True, own=True), function("log", "c.py", sink=True, cwe=[117]), function("run", "d.py", sink=True),
        function("get", "e.py", source=True, classified=False), function("echo", "f.py", return_params=["0"]), function("user", "g.py", sink=True, sink_calls=["get"]),
    ]
    calls = [("remote", "log"), ("own", "run"), ("user", "get"), ("user", "echo"), ("user", "run")]
    found = emitted(spark, functions, [(a, b, b, True, ["0"]) for a, b in calls])
    assert {k: (r.severity, r.confidence, r.rule_id) for k, r in found.items()} == {
        ("sink", "remote", "log"): ("medium", 0.75, "CF-SINK-001"), ("sink", "own", "run"): ("medium", 0.5, "CF-SINK-001"),
        ("return", "user", "get"): ("low", 0.75, "CF-RETURN-001"), ("return", "user", "echo"): ("high", 0.75, "CF-RETURN-001"),
    }


def test_merge_keeps_the_sink_direction_and_the_greater_confidence(spark):
    rows = spark.createDataFrame([("return", "a", "b", 2, 0.9), ("sink", "a", "b", 0, 0.4)], "direction string, caller string, callee string, depth int, confidence double")
    (row,) = graph.merge_directions(rows).collect()
    assert (row.direction, row.depth, row.confidence) == ("sink", 0, 0.9)


def test_handoff_stops_at_schemas(spark):
    nodes = spark.createDataFrame([("a", True, False), ("b", False, False), ("c", False, True), ("d", False, False)], "node string, armed boolean, has_schema boolean")
    found = {r.node for r in graph.handoffs(nodes, edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])).collect()}
    assert found == {"a", "b"}


@pytest.mark.parametrize("rounds", [5])
def test_fixpoint_spreads_through_a_cycle(spark, rounds):
    from pyspark.sql import functions as F

    state = spark.createDataFrame([("c", ["p"]), ("a", ["q"])], "node string, value array<string>")
    combine = lambda rows: rows.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set("value"))).alias("value"))
    out = graph.fixpoint(state, "node", edges(spark, [("a", "b"), ("b", "c"), ("b", "a")]), combine, rounds)
    assert {r.node: r.value for r in out.collect()} == {"a": ["p", "q"], "b": ["p", "q"], "c": ["p"]}
    with pytest.raises(RuntimeError):
        graph.fixpoint(state, "node", edges(spark, [("a", "b"), ("b", "c"), ("b", "a")]), combine, 1)


def test_many_fronts(spark, monkeypatch):
    monkeypatch.setattr(graph, "FRONTS", 2)
    e = edges(spark, [(f"n{k}", f"n{k + 1}") for k in range(8)])
    found = graph.layers(e, seeds(spark, "n8"))
    assert {r.node: (r.dist, r.origin) for r in found.collect()} == {f"n{k}": (8 - k, "n8") for k in range(9)}
    assert max(len(r.path) for r in graph.paths(found).collect()) == 9


def test_emissions_write_edges_once(spark, monkeypatch):
    """The searches read one table of edges; what they write themselves are nodes."""
    rng = random.Random(3)
    names = [f"n{k}" for k in range(12)]
    functions = [function(n, f"{k % 5}.py", k % 4 == 0, k % 3 == 0, k % 2 == 0, [None, [], ["0"]][k % 3], [None, ["0"]][k % 2], cwe=[89]) for k, n in enumerate(names)]
    calls = [(rng.choice(names), b := f"leaf{k}" if k % 2 else rng.choice(names), b, True, rng.choice([None, [], ["0"], ["1"]])) for k in range(400)]
    functions += [function(f"leaf{k}", "leaf.py") for k in range(1, 400, 2)]
    written = []
    for name in ("cut", "stored"):
        write = getattr(materialise, name)
        monkeypatch.setattr(graph, name, lambda df, write=write: (written.append((out := write(df)).filter("false" if "caller" not in df.columns and "_far" not in df.columns else "true").count()), out)[1], raising=False)
    assert emitted(spark, functions, calls)
    assert sum(written) == len(calls)


def test_fixpoint_makes_its_edges_once(spark):
    """What makes the edges runs once, not in every round."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    way = edges(spark, [(f"n{k:02}", f"n{k + 1:02}") for k in range(8)]).mapInArrow(counted, "caller string, callee string")
    state = spark.createDataFrame([("n08", ["x"]), ("n05", ["y"])], "node string, value array<string>")
    combine = lambda rows: rows.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("value"))).alias("value"))
    out = {r.node: r.value for r in graph.fixpoint(state, "node", way, combine).collect()}
    assert out == {f"n{k:02}": ["x", "y"] if k <= 5 else ["x"] for k in range(9)}
    assert made.value == 8


def test_large_tables_do_not_pass_through_the_driver(spark, monkeypatch):
    """Tables of nodes pack so well that the planner takes them for small ones; beyond SENT rows none is sent whole."""
    monkeypatch.setattr(materialise, "SENT", 2)
    monkeypatch.setattr(graph, "SENT", 2)
    functions = [(k, k, k == 9, k == 0, False, None, None, None, None, [89], False) for k in range(10)]
    edges = [(k, k + 1, "f", True, None) for k in range(9)]
    out = graph.emissions(
        spark.createDataFrame(edges, "caller int, callee int, callee_name string, has_args boolean, tainted_slots array<string>"),
        spark.createDataFrame(
            functions,
            "node int, file int, has_sink boolean, has_source boolean, operator_only boolean, sink_params array<string>, return_params array<string>, "
            "sink_calls array<string>, returned_calls array<string>, sink_cwe array<int>, classified boolean",
        ),
    )
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.caller, r.depth) for r in out.collect() if r.direction == "sink") == [(k, 8 - k) for k in range(9)]
