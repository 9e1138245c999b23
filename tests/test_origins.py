"""Summaries and walks across functions, loops and proofs, against brute force on random graphs."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from sievekit.operators import loops, materialise, origins, proofs

ORIGINS, MOVES = "fn string, origin string, node string, seed boolean", "fn string, src string, dst string"
ARGUMENTS, RESULTS = "fn string, call long, callee string, slot string, src string", "fn string, call long, callee string, dst string"


def walked(spark, start, moves, arguments, results, most=None):
    rows = origins.walk(spark.createDataFrame(start, ORIGINS), spark.createDataFrame(moves, MOVES), spark.createDataFrame(arguments, ARGUMENTS), spark.createDataFrame(results, RESULTS), most)
    out = collections.Counter((r.fn, r.origin, r.node, r.seed, r.level) for r in rows.collect())
    assert max(out.values(), default=1) == 1
    return set(out)


def brute(start, moves, arguments, results, most=None):
    """Lowers levels until nothing changes."""
    level = {(f, o, n, s): 0 for f, o, n, s in start}
    again = True
    while again:
        again = False
        for (fn, origin, node, seed), at in list(level.items()):
            news = [((fn, origin, dst, seed), at) for f, src, dst in moves if (f, src) == (fn, node)]
            for f, call, callee, slot, src in arguments:
                if (f, src) != (fn, node):
                    continue
                for (g, o, exit_, s), inner in list(level.items()):
                    if (g, o, s) == (callee, slot, False) and exit_[0] == "@":
                        targets = [d for h, c, _, d in results if (h, c) == (f, call)] if exit_ == "@return" else [exit_]
                        news += [((fn, origin, t, seed), max(at, inner + 1)) for t in targets]
            if seed and node == "@return":
                news += [((f, origin, dst, True), at + 1) for f, _, callee, dst in results if callee == fn]
            for fact, at_ in news:
                if fact not in level or level[fact] > at_:
                    level[fact], again = at_, True
    return {(*fact, at) for fact, at in level.items() if most is None or at <= most}


def program(seed):
    rng = random.Random(seed)
    names, fns = ["p0", "p1", "a", "b", "c"], [f"f{k}" for k in range(6)]
    start = [(f, p, p, False) for f in fns for p in ("p0", "p1")] + [(f, f"s{f}", rng.choice(names), True) for f in rng.sample(fns, 3)]
    moves = [(rng.choice(fns), rng.choice(names), rng.choice([*names, "@return", "@sink 1", "@sink 2"])) for _ in range(18)]
    arguments, results = [], []
    for call in range(10):
        f, g = rng.choice(fns), rng.choice(fns)
        arguments += [(f, call, g, p, rng.choice(names)) for p in rng.sample(["p0", "p1"], rng.randint(1, 2))]
        if rng.random() < 0.7:
            results.append((f, call, g, rng.choice(names)))
    return start, moves, arguments, results


@pytest.mark.parametrize("seed", range(2))
def test_walk(spark, seed):
    facts = program(seed)
    assert walked(spark, *facts) == brute(*facts)
    assert walked(spark, *facts, most=1) == brute(*facts, most=1)


def test_chain_diamond_cycle_and_hop_limit(spark):
    """f0 calls f1 calls ... f8, whose parameter reaches a sink; d1 and d2 pass through; r calls itself."""
    start = [(f"f{k}", "p0", "p0", False) for k in range(9)] + [("main", "s", "x", True)] + [(f, "p0", "p0", False) for f in ("d", "d1", "d2", "r")]
    moves = [("f8", "p0", "@sink"), ("d1", "p0", "@return"), ("d2", "p0", "@return"), ("d", "t1", "@return"), ("d", "t2", "@return"), ("r", "p0", "@return")]
    arguments = [(f"f{k}", 1, f"f{k + 1}", "p0", "p0") for k in range(8)] + [("d", 1, "d1", "p0", "p0"), ("d", 2, "d2", "p0", "p0"), ("r", 1, "r", "p0", "p0"), ("main", 1, "f2", "p0", "x"), ("main", 2, "f0", "p0", "x")]
    results = [("d", 1, "d1", "t1"), ("d", 2, "d2", "t2"), ("r", 1, "r", "p0")]
    facts = start, moves, arguments, results
    found = walked(spark, *facts)
    assert found == brute(*facts)
    rows = spark.createDataFrame(sorted(found), "fn string, origin string, node string, seed boolean, level int")
    fns = spark.createDataFrame([("f0", True), ("f3", True), ("d", True), ("r", True), ("main", True), ("other", False)], "fn string, summarised boolean")
    out = {r.fn: (r.sink_params, r.return_params) for r in origins.parameter_summaries(fns, rows).collect()}
    assert out == {"f0": (["p0"], []), "f3": (["p0"], []), "d": ([], ["p0"]), "r": ([], ["p0"]), "main": ([], []), "other": (None, None)}
    assert [tuple(r) for r in origins.seed_flows(rows).collect()] == [("s", "sink", 8, "main")]
    assert not [r for r in walked(spark, *facts, most=6) if r[0] == "main" and r[2] == "@sink"]  # seven calls, one within the other


def test_seeds_that_come_back(spark):
    """A seed is returned over two calls and ends in a sink; within one function it isn't a flow."""
    facts = [("a", "s1", "x", True), ("c", "s2", "y", True)], [("a", "x", "@return"), ("c", "t", "@sink"), ("c", "y", "@sink")], [], [("b", 1, "a", "@return"), ("c", 1, "b", "t")]
    found = walked(spark, *facts)
    assert found == brute(*facts)
    rows = spark.createDataFrame(sorted(found), "fn string, origin string, node string, seed boolean, level int")
    assert [tuple(r) for r in origins.seed_flows(rows).collect()] == [("s1", "sink", 3, "c")]
    assert walked(spark, [], [], [], []) == set()


def components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    again = True
    while again:
        again = False
        for a, b in edges:
            for n in nodes:
                if a in reach[n] and b not in reach[n]:
                    reach[n].add(b)
                    again = True
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize(("n", "m"), [(30, 25), (30, 45), (12, 60), (40, 0)])
def test_strong_components(spark, n, m):
    rng = random.Random(m)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k + 100, k + 101) for k in range(3)] + [(200, 200), (None, 1)]
    out = loops.strong_components(spark.createDataFrame(edges, "caller long, callee long"))
    assert {r.node: r.component for r in out.collect()} == components([e for e in edges if e[0] is not None])


def test_a_hub_and_a_long_circle(spark):
    hub = spark.range(1, 100_001).selectExpr("0L as caller", "id as callee").unionByName(spark.range(1, 50_001).selectExpr("id as caller", "0L as callee"))
    circle = spark.range(20).selectExpr("200000 + id as caller", "200000 + (id + 1) % 20 as callee")
    out = {r.component: (r.members, r.inner_edges) for r in loops.feedback_loops(hub.unionByName(circle)).collect()}
    assert out == {0: (50_001, 100_000), 200_000: (20, 20)}
    assert loops.feedback_loops(spark.createDataFrame([(1, 1), (2, 3)], "caller long, callee long")).collect()[0].asDict() == {"component": 1, "members": 1, "inner_edges": 1}


def test_selected_tools(spark):
    frame = spark.createDataFrame
    dispatches = frame([("a.py", "run", 5, "TOOLS", 4), ("a.py", "run", 9, "OWN", 4), ("b.py", "go", 2, "TOOLS", 1), ("b.py", "go", 3, "HARMLESS", 1)], "file string, fn string, line long, registry string, model_line long")
    imports = frame([("a.py", "TOOLS", "t.py", "ALL")], "file string, local_name string, target_file string, target_name string")
    registries = frame([("t.py", "ALL", 0, "sh"), ("t.py", "ALL", 1, "sh2"), ("t.py", "ALL", 2, "npx"), ("a.py", "OWN", 0, "write"), ("b.py", "HARMLESS", 0, "add")], "file string, registry string, place long, function string")
    capabilities = frame(
        [("t.py", "sh", "shell", 3), ("t.py", "sh2", "shell", 1), ("t.py", "npx", "unpinned package supply chain execution", 8), ("a.py", "write", "file write", 20)], "file string, function string, capability string, line long"
    )
    edges = frame([("a.py:run", "t.py:sh2"), ("t.py:sh2", "a.py:run"), ("a.py:run", "a.py:write")], "caller string, callee string")
    out = loops.capability_findings(dispatches, imports, registries, capabilities, edges).collect()
    assert {(r.file, r.line): (r.registry_file, r.capabilities, r.sink_function, r.sink_line, r.cwe, r.feedback_loop) for r in out} == {
        ("a.py", 5): ("t.py", ["shell", "unpinned package supply chain execution"], "sh", 3, [284, 829], True),
        ("a.py", 9): ("a.py", ["file write"], "write", 20, [284], False),
    }


@pytest.mark.parametrize(("n", "m"), [(30, 25), (60, 40), (12, 40)])
def test_nodes_that_call_each_other(spark, n, m):
    """Pairs of mutual calls, a few circles beside them: of the former nothing is left for the rounds."""
    rng = random.Random(n)
    mutual = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    mutual = [e for a, b in mutual if a != b for e in ((a, b), (b, a))]
    assert loops._merged(spark.createDataFrame(mutual, "caller long, callee long"))[1].isEmpty()
    edges = mutual + [(rng.randrange(n), rng.randrange(n)) for _ in range(m // 2)]
    for kind, name in (("long", int), ("string", "{:03d}".format)):
        named = [(name(a), name(b)) for a, b in edges]
        out = loops.strong_components(spark.createDataFrame(named, f"caller {kind}, callee {kind}"))
        assert {r.node: r.component for r in out.collect()} == components(named)


def test_selected_tools_by_number(spark):
    """Files, functions and registries as numbers; function 7 calls itself and holds itself, 8 doesn't, and a capability of another file's function isn't its own."""
    frame = spark.createDataFrame
    dispatches = frame([(70, 1, 7, 1, 5, 1), (80, 1, 8, 1, 6, 1), (80, 1, 8, 2, 5, 1)], "node long, file long, fn long, line long, registry long, model_line long")
    imports = frame([], "file long, local_name long, target_file long, target_name long")
    registries = frame([(70, 1, 5, 0, 7), (80, 1, 6, 0, 8)], "node long, file long, registry long, place long, function long")
    capabilities = frame([(70, 1, 7, "shell", 3), (80, 1, 8, "shell", 4), (80, 2, 8, "file write", 5)], "node long, file long, function long, capability string, line long")
    edges = frame([(70, 70), (80, 90), (90, 80), (80, 70)], "caller long, callee long")
    out = loops.capability_findings(dispatches, imports, registries, capabilities, edges)
    assert out.columns[:5] == ["file", "fn", "line", "registry", "model_line"]
    assert {(r.fn, r.registry): (r.capabilities, r.sink_function, r.sink_line, r.feedback_loop) for r in out.collect()} == {
        (7, 5): (["shell"], 7, 3, True), (8, 6): (["shell"], 8, 4, False), (8, 5): (["shell"], 7, 3, False),
    }


def proven(definitions, premises):
    parts = collections.defaultdict(set)
    for d, p in premises:
        parts[d].add(p)
    ways = collections.defaultdict(set)
    for d in set(definitions):
        ways[d[0]].add(d[1:])
    kinds: dict = {}

    def kind_of(definition, operation, literal):
        if operation == "convert":
            return "number"
        if literal is not None:
            return literal if literal in ("number", "text") else None
        own = parts[definition]
        if not own or not own <= kinds.keys():
            return None
        found = {kinds[p] for p in own}
        match operation:
            case "copy":
                return found.pop() if len(found) == 1 else None
            case "arithmetic":
                return "number" if found == {"number"} else None
            case "join":
                return "text" if found == {"text"} else None
            case "format":
                return "text"
        return None

    again = True
    while again:
        again = False
        for value, own in ways.items():
            found = {kind_of(*d) for d in own}
            if value not in kinds and len(found) == 1 and None not in found:
                kinds[value], again = found.pop(), True
    return kinds


@pytest.mark.parametrize("seed", range(4))
def test_bounded_values(spark, seed):
    rng = random.Random(seed)
    definitions, premises = [], []
    for k in range(70):
        value = rng.randrange(40)
        literal = rng.choice(["number", "text", "unknown", None, None]) if rng.random() < 0.5 else None
        definitions.append((value, k, rng.choice([*proofs.OPERATIONS, "copy", "format", "strange"]), literal))
        premises += [(k, rng.randrange(48)) for _ in range(rng.randint(0, 2))]
    definitions += definitions[:3]
    premises += premises[:3]
    out = proofs.bounded(spark.createDataFrame(definitions, "value long, definition long, operation string, literal string"), spark.createDataFrame(premises, "definition long, part long"))
    assert {r.value: r.kind for r in out.collect()} == proven(definitions, premises)


def test_circles_stay_unproven(spark):
    definitions = [("a", 1, "copy", None), ("b", 2, "copy", None), ("c", 3, "copy", "number"), ("d", 4, "arithmetic", None), ("e", 5, "copy", None), ("e", 6, "copy", "text")]
    premises = [(1, "b"), (2, "a"), (4, "c"), (5, "c")]
    out = proofs.bounded(spark.createDataFrame(definitions, "value string, definition long, operation string, literal string"), spark.createDataFrame(premises, "definition long, part string"))
    assert {r.value: r.kind for r in out.collect()} == {"c": "number", "d": "number"}
    findings = spark.createDataFrame([("f", 1, "TNT-LOG-001"), ("f", 2, "TNT-LOG-001"), ("f", 1, "TNT-SQL-001"), ("f", 3, "TNT-LOG-001")], "path string, line long, rule_id string")
    logged = spark.createDataFrame([("f", 1, "c"), ("f", 1, "d"), ("f", 2, "c"), ("f", 2, "a"), ("f", 3, None)], "path string, line long, value string")
    left = proofs.without_bounded(findings, logged, out)
    assert sorted((r.line, r.rule_id) for r in left.collect()) == [(1, "TNT-SQL-001"), (2, "TNT-LOG-001"), (3, "TNT-LOG-001")]


def test_facts_of_nothing(spark):
    empty = spark.createDataFrame([], "caller long, callee long")
    assert loops.strong_components(empty).count() == 0 and loops.feedback_loops(empty).count() == 0
    none = proofs.bounded(spark.createDataFrame([], "value long, definition long, operation string, literal string"), spark.createDataFrame([], "definition long, part long"))
    assert none.count() == 0 and list(itertools.chain(none.columns)) == ["value", "kind"] and none.filter(F.col("kind").isNull()).count() == 0


def test_walk_writes_no_facts_of_functions_that_nothing_calls(spark, monkeypatch):
    """Rows written by the walk grow with calls and with what called functions know, not with all facts."""
    written, cut = [], origins.cut
    monkeypatch.setattr(origins, "cut", lambda df: (written.append((out := cut(df)).count()), out)[1])
    fns = [f"g{k}" for k in range(50)]
    start = [(f, p, p, False) for f in [*fns, "callee"] for p in ("p0", "p1")]
    moves = [(f, a, b) for f in fns for a, b in (("p0", "a"), ("a", "b"), ("p1", "c"), ("c", "d"))] + [("callee", "p0", "@sink")]
    arguments = [(f, 1, "callee", "p0", "b") for f in fns]
    facts = walked(spark, start, moves, arguments, [])
    assert facts == brute(start, moves, arguments, [])
    assert sum(written) < len(facts) < 360


def test_loops_of_registries_meet_by_component_not_by_tool(spark):
    """One tool that is the dispatching function itself loops only if it calls itself; with another one in its component it does anyway."""
    frame = spark.createDataFrame
    dispatches = frame([("a", f, k, r, 1) for k, (f, r) in enumerate([("x", "ONE"), ("y", "ONE_SELF"), ("z", "TWO"), ("z", "AWAY")])], "file string, fn string, line long, registry string, model_line long")
    imports = frame([], "file string, local_name string, target_file string, target_name string")
    held = [("ONE", "x"), ("ONE_SELF", "y"), ("TWO", "z"), ("TWO", "t"), ("AWAY", "q")]
    registries = frame([("a", r, k, f) for k, (r, f) in enumerate(held)], "file string, registry string, place long, function string")
    capabilities = frame([("a", f, "shell", 1) for f in "xyztq"], "file string, function string, capability string, line long")
    edges = frame([("a:x", "a:w"), ("a:w", "a:x"), ("a:y", "a:y"), ("a:z", "a:t"), ("a:t", "a:z"), ("a:z", "a:q")], "caller string, callee string")
    out = loops.capability_findings(dispatches, imports, registries, capabilities, edges)
    assert {r.registry: r.feedback_loop for r in out.collect()} == {"ONE": False, "ONE_SELF": True, "TWO": True, "AWAY": False}
    assert "_tool" not in out.columns


def test_components_need_few_rounds_of_a_long_circle(spark, monkeypatch):
    """Rounds grow with the logarithm of a circle's length, and a long way between two circles is no component."""
    written, stored = [], loops.stored
    monkeypatch.setattr(loops, "stored", lambda df: (written.append(1), stored(df))[1])
    circle = lambda n, at: [(at + k, at + (k + 1) % n) for k in range(n)]
    edges = circle(400, 0) + circle(7, 1000) + [(2000 + k, 2001 + k) for k in range(300)] + [(5, 2000), (2300, 1003), (1, 0), (0, 9)]
    out = loops.strong_components(spark.createDataFrame([(f"n{a:05}", f"n{b:05}") for a, b in edges], "caller string, callee string"))
    found = {r.node: r.component for r in out.collect()}
    assert all(found[f"n{k:05}"] == "n00000" for k in range(400)) and all(found[f"n{k:05}"] == "n01000" for k in range(1000, 1007))
    assert all(found[f"n{k:05}"] == f"n{k:05}" for k in range(2000, 2301)) and len(found) == 708
    assert len(written) < 120


@pytest.mark.parametrize("kind", ["long", "string"])
def test_feedback_loops_write_nothing_of_nodes_that_are_not_called(spark, monkeypatch, kind):
    """Loops equal the brute force, and rows written grow with what may lie in a circle, not with all edges."""
    rng = random.Random(7)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(38)} | {(40, 41), (41, 40), (41, 42), (42, 41), (50, 50), (None, 1)}
    of = components([e for e in edges if e[0] is not None])
    expected = {}
    for c in set(of.values()):
        inner = sum(1 for a, b in edges if a is not None and of[a] == of[b] == c)
        if inner:
            expected[c] = (sum(1 for x in of.values() if x == c), inner)
    assert len(expected) > 2
    written, stored = [], loops.stored
    monkeypatch.setattr(loops, "stored", lambda df: (written.append((out := stored(df)).count()), out)[1])
    rows = [*edges, *((k, rng.randrange(30)) for k in range(1000, 6000))]
    frame = spark.createDataFrame(rows, "caller long, callee long")
    if kind == "string":
        frame = frame.selectExpr("'n' || lpad(caller, 5, '0') as caller", "'n' || lpad(callee, 5, '0') as callee")
        expected = {f"n{c:05}": n for c, n in expected.items()}
    assert {r.component: (r.members, r.inner_edges) for r in loops.feedback_loops(frame).collect()} == expected
    assert sum(written) < 2000


def test_values_without_a_chance_are_not_written(spark, monkeypatch):
    """A definition that is never bounded, or literals of both kinds, tell a value before its definitions meet their premises."""
    written = []
    for name in ("cut", "stored"):
        write = getattr(materialise, name)
        monkeypatch.setattr(proofs, name, lambda df, write=write: (written.append((out := write(df)).count()), out)[1], raising=False)
    definitions, premises = [(0, 0, "copy", "number"), (1, 1, "copy", None), (1, 1, "format", None)], [(1, 0)]
    for v in range(2, 202):
        definitions += [(v, 10 * v, "copy", None), (v, 10 * v + 1, "character" if v % 2 else "join", None if v % 2 else "number"), (v, 10 * v + 2, "copy", "text")]
        premises += [(10 * v, v - 1)]
    definitions += [(300, 3000, "copy", None), (300, 3001, "copy", "number"), (301, 3010, "copy", None)]
    premises += [(3000, 0), (3010, 300), (3010, 0)]
    out = proofs.bounded(spark.createDataFrame(definitions, "value long, definition long, operation string, literal string"), spark.createDataFrame(premises, "definition long, part long"))
    assert {r.value: r.kind for r in out.collect()} == {0: "number", 300: "number", 301: "number"} == proven(definitions, premises)
    assert sum(written) < 40
