"""Evidence near sinks, guards that dominate, matchings and chases, against brute force."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from sievekit.operators import evaluation, guards, joins, selection


def near(sinks, lines, before, after, stop):
    """Every pair of a sink and a line of its path."""
    words = lambda t: set(re.findall("[A-Za-z_][A-Za-z0-9_]*", t)) - set(stop)
    by_path = collections.defaultdict(dict)
    for path, n, text in lines:
        by_path[path][n] = text
    out = {}
    for finding, path, at in sinks:
        own = by_path[path]
        depth, statement, ids = 0, 0, {}
        for n in sorted(own):
            ids[n] = statement
            depth = max(0, depth + sum(c in "([{" for c in own[n]) - sum(c in ")]}" for c in own[n]))
            statement += depth == 0
        found = set()
        for n, text in own.items():
            kinds = {k for k, mark in (("call", "check"), ("shape", "=")) if mark in text}
            if n == at or (at - before <= n <= at + after and words(text) & words(own[at])):
                found |= kinds
            if ids[n] == ids[at]:
                found |= kinds & {"shape"}
        if found:
            out[finding] = sorted(found)
    return out


@pytest.mark.parametrize(("before", "after"), [(2, 2), (5, 0)])
def test_near_evidence(spark, before, after):
    rng = random.Random(before)
    pieces = ["check(a", "b)", "x = y", "if a", "call(", "c, k=1)", "the", "b", "", "use(a)", "a b c", "zz"]
    lines = [(path, n, " ".join(rng.choices(pieces, k=rng.randint(0, 2)))) for path in ("p", "q") for n in range(1, 40)]
    sinks = [(f"{p}{n}", p, n) for p in ("p", "q") for n in rng.sample(range(1, 40), 15)] + [("twice", "p", 5)]
    df = spark.createDataFrame(lines, "path string, line_no long, line string")
    kinds = F.array_compact(F.array(F.when(F.col("line").contains("check"), "call"), F.when(F.col("line").contains("="), "shape")))
    out = guards.near_evidence(spark.createDataFrame(sinks, "finding string, path string, line long"), df, kinds, F.array(F.lit("shape")), before, after, ["the"])
    assert {r.finding: r.evidence for r in out.collect()} == near(sinks, lines, before, after, ["the"])


def random_tree(rng, line, depth, name):
    """Blocks as (block, begin, end), statements as (block, line, inner blocks); returns the next free line."""
    blocks, statements, begin = [], [], line
    for k in range(rng.randint(1, 4)):
        first, inner = line, []
        line += 1
        if depth and rng.random() < 0.6:
            for arm in range(rng.randint(1, 2)):
                more_blocks, more, line = random_tree(rng, line, depth - 1, f"{name}.{k}.{arm}")
                blocks += more_blocks
                statements += more
                inner.append(more_blocks[-1][0])
        statements.append((name, first, line - 1))
    return [*blocks, (name, begin, line - 1)], statements, line


@pytest.mark.parametrize("seed", range(3))
def test_dominating_guards(spark, seed):
    """On random trees of statements: what stands earlier in a list on the way to the sink."""
    rng = random.Random(seed)
    blocks, statements, tests, assigned, sinks, wanted = [], [], [], [], [], {}
    for f in range(4):
        own_blocks, own, end = random_tree(rng, 1, 3, "b")
        blocks += [(f"f{f}", *b) for b in own_blocks]
        statements = own
        own_tests = [(name, var, last, rng.choice(["prefix", "membership"])) for name, _, last in statements for var in "xy" if rng.random() < 0.5]
        own_assigned = [(var, n) for var in "xy" for n in rng.sample(range(1, end), max(1, end // 6))]
        tests += [(f"f{f}", *t) for t in own_tests]
        assigned += [(f"f{f}", "s", *a) for a in own_assigned]
        for line in range(1, end):
            var = rng.choice("xy")
            sinks.append((f"f{f}:{line}:{var}", f"f{f}", "s", line, var))
            holding = [(name, a) for name, a, b in statements if a <= line <= b]
            ahead = [
                (at, kind) for name, v, at, kind in own_tests
                if v == var and at < line and any(name == held and at < a for held, a in holding) and not any(w == var and at < n < line for w, n in own_assigned)
                and not any(w == var and n == at for w, n in own_assigned)
            ]
            if ahead:
                wanted[sinks[-1][0]] = min(ahead)
    frame = spark.createDataFrame
    out = guards.dominating_guards(
        frame(sinks, "finding string, path string, scope string, line long, var string"), frame(blocks, "path string, block string, begin long, end long"),
        frame(tests, "path string, block string, var string, line long, kind string"), frame(assigned, "path string, scope string, var string, line long"),
    )
    rows = {r.finding: (r.guard_line, r.kind) for r in out.collect()}
    assert rows == wanted


def test_flows_behind_guards_are_demoted(spark):
    findings = spark.createDataFrame([("a", 0.9, True), ("b", 0.2, True), ("c", 0.9, False), ("d", 0.9, True)], "finding string, confidence double, has_flow boolean")
    guarded = spark.createDataFrame([(f, 1, "prefix") for f in "abc"], "finding string, guard_line long, kind string")
    out = {r.finding: (r.confidence, r.guard_kind) for r in guards.demoted_by_guards(findings, guarded).collect()}
    assert out == {"a": (0.3, "prefix"), "b": (0.2, "prefix"), "c": (0.9, None), "d": (0.9, None)}


def greedy(candidates):
    pairs, findings, sinks = {}, set(), set()
    for rank, distance, sink, finding in sorted((r, d, s, f) for f, s, r, d in candidates):
        if finding not in findings and sink not in sinks:
            pairs[finding] = sink
            findings.add(finding)
            sinks.add(sink)
    return pairs


@pytest.mark.parametrize("seed", range(3))
def test_one_to_one_is_the_sequential_match(spark, seed):
    rng = random.Random(seed)
    candidates = [(rng.randrange(30), rng.randrange(15), rng.randrange(3), rng.randrange(4)) for _ in range(90)]
    out = evaluation.one_to_one(spark.createDataFrame(candidates, "finding long, sink long, rank int, distance long"))
    assert {r.finding: r.sink for r in out.collect()} == greedy(candidates)
    assert evaluation.one_to_one(spark.createDataFrame([], "finding long, sink long, rank int, distance long")).count() == 0


def test_states_add_up(spark):
    frame = spark.createDataFrame
    findings = frame(
        [("a", "p", 10, [1], "R"), ("b", "p", 12, [1], "R"), ("c", "p", 11, [2], "R"), ("d", "p", 90, [1], "R"), ("e", "p", 30, [9], "R"), ("f", "p", 13, [], "R"), ("g", "p", 14, [], "N"), ("h", "p", 40, [1], "Q")],
        "finding string, path string, line long, cwe array<int>, rule_id string",
    )
    expected = frame([("s1", "p", 10, 1, None), ("s2", "p", 14, 5, "N"), ("s3", "p", 45, 1, None)], "sink string, path string, line_hint long, cwe int, native_rule string")
    decoys = frame([("p", 28, 33, 9), ("q", 1, 99, 1)], "path string, first long, last long, cwe int")
    scored = evaluation.distinct_findings(findings, expected, decoys)
    assert {r.finding: (r.state, r.sink) for r in scored.collect()} == {
        "a": ("hit", "s1"), "b": ("duplicate", "s1"), "c": ("mismatch", "s1"), "d": ("unmatched", None), "e": ("decoy", None), "f": ("unmatched", None), "g": ("hit", "s2"), "h": ("hit", "s3"),
    }
    rows = {r.rule_id: tuple(r)[1:] for r in evaluation.rule_scores(scored).collect()}
    assert rows == {"R": (6, 1, 1, 1, 1, 2), "N": (1, 1, 0, 0, 0, 0), "Q": (1, 1, 0, 0, 0, 0)}


def test_chases_end_at_definitions_only(spark):
    chain = [(f"f{k}", "x", 0, f"f{k + 1}", "x") for k in range(7)]
    exports = [*chain, ("g", "y", 0, "h", "z"), ("h", "z", 0, "g", "y"), ("s", None, 1, "t", None), ("s", None, 0, "u", None), ("t", "w", 0, "d", "w2"), ("u", "w", 0, "nowhere", "w"), ("s", "v", 2, "d", "v")]
    names = [("f0", "x"), ("f2", "x"), ("g", "y"), ("s", "w"), ("s", "v"), ("d", "v"), ("none", "x")]
    frame = spark.createDataFrame
    out = joins.re_exports(
        frame(names, "file string, name string"), frame(exports, "file string, name string, place int, target_file string, target_name string"), frame([("f7", "x"), ("d", "w2"), ("d", "v")], "file string, name string")
    )
    assert {(r.file, r.name): (r.final_file, r.final_name) for r in out.collect()} == {
        ("f0", "x"): (None, None), ("f2", "x"): ("f7", "x"), ("g", "y"): (None, None), ("s", "w"): ("d", "w2"), ("s", "v"): ("d", "v"), ("d", "v"): ("d", "v"), ("none", "x"): (None, None),
    }


def test_priority_with_ties(spark):
    rows = [(k, "line", 2, False, None, 0.7, k % 2 == 0, "same") for k in range(40)] * 2
    df = spark.createDataFrame(rows, "k long, engine string, sev_rank int, has_flow boolean, reachability string, confidence double, is_ai boolean, path string")
    out = selection.priority(df, ["path"], 30).collect()
    assert len(out) == 54  # the first 30 rows, 16 of them AI findings, and the other 24 of these
    assert collections.Counter(r.k for r in out if r.is_ai) == {k: 2 for k in range(0, 40, 2)}


def test_partners_and_classes_without_pairs(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(6), rng.choice(["read", "write", "other"]), rng.randrange(12)) for _ in range(90)] + [(None, "read", 1)]
    held = {r for r in rows if r[0] is not None}
    wanted = {}
    for key, role, fn in held:
        met = {g for k, r, g in held if k == key and {r, role} == {"read", "write"} and g != fn}
        if met:
            wanted[key, role, fn] = (len(met), min(met))
    out = joins.partners(spark.createDataFrame(rows, "key long, role string, fn_id long"), ["key"])
    assert {(r.key, r.role, r.fn_id): (r.partners, r.first_partner) for r in out.collect()} == wanted
    writes = [(rng.randrange(3), rng.choice([None, "a", "b", "c"]), k) for k in range(25)]
    reads = [(rng.randrange(3), rng.choice([None, "a", "b", "d"]), k) for k in range(25)]
    w, r = spark.createDataFrame(writes, "key long, file string, writer long"), spark.createDataFrame(reads, "key long, file string, reader long")
    pairs = joins.unresolved_match(w, r, ["key"]).groupBy("key", F.col("file").alias("writer_file"), "reader_file").agg(
        F.count_distinct("writer").alias("writers"), F.count_distinct("reader").alias("readers"), F.min("writer").alias("first_writer"), F.min("reader").alias("first_reader")
    )
    assert collections.Counter(map(tuple, joins.unresolved_classes(w, r, ["key"]).select(pairs.columns).collect())) == collections.Counter(map(tuple, pairs.collect()))


def test_stored_flows_query_returns_every_pair(spark):
    """Each writer with each reader of a key, by the key that 200 users share."""
    from pathlib import Path

    from sievekit.plans import checks

    if not Path("/root/testdata/sf0.001").is_dir():
        return
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").collect()
    writers = [r for r in rows if r.event_type == "signup" and r.value > 60]
    readers = [r for r in rows if r.event_type == "error" and r.value < 20]
    wanted = {(w.user_id % 200, w.event_id, r.event_id) for w in writers for r in readers if w.user_id % 200 == r.user_id % 200}
    out = [(r.key, r.writer, r.reader) for r in checks.persistent_flows(spark, "/root/testdata/sf0.001").collect()]
    assert len(out) == len(set(out)) and set(out) == wanted


def test_unresolved_stores_query_returns_every_pair(spark):
    from pathlib import Path

    from sievekit.plans import checks

    if not Path("/root/testdata/sf0.001").is_dir():
        return
    rows = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").collect()
    file = lambda r: r.o_orderpriority if r.o_orderkey % 3 > 0 else None
    wanted = {
        (w.o_custkey, w.o_orderkey, r.o_orderkey)
        for w in rows for r in rows
        if (w.o_orderstatus, r.o_orderstatus) == ("O", "F") and w.o_custkey == r.o_custkey and (None in (file(w), file(r)) or file(w) == file(r))
    }
    out = [(r.key, r.writer, r.reader) for r in checks.unresolved_stores(spark, "/root/testdata/sf0.001").collect()]
    assert len(out) == len(set(out)) and set(out) == wanted


@pytest.mark.parametrize("long", [8, 3000])
def test_points_look_only_where_a_scope_holds_them(spark, monkeypatch, long):
    """All pairs of a point and a scope that holds it, and no more copies of points than such pairs."""
    rng = random.Random(long)
    points = [(k, rng.choice(["a", "b", None]), rng.randrange(-1000, 20_000)) for k in range(300)]
    scopes = [(k, rng.choice(["a", "b"]), at := rng.randrange(-1000, 20_000), at + rng.randrange(-1, rng.choice([2, 9, long]))) for k in range(60)]
    copies, looking = [], joins._looking
    monkeypatch.setattr(joins, "_looking", lambda *args: (copies.append((out := looking(*args)).count()), out)[1])
    frame = spark.createDataFrame
    out = joins.containing(frame(points, "point int, path string, line int"), frame(scopes, "scope int, path string, b long, e long"), "path", "line", "b", "e", ["scope"])
    assert out.columns == ["path", "point", "line", "b", "e", "scope"]
    expected = sorted((p, s) for p, f, at in points for s, g, b, e in scopes if f == g and b <= at <= e)
    assert sorted((r.point, r.scope) for r in out.collect()) == expected and copies[0] <= len(expected)
    none = joins.containing(frame(points, "point int, path string, line int"), frame([], "scope int, path string, b long, e long"), "path", "line", "b", "e", ["scope"])
    assert none.columns == out.columns and none.count() == 0


def test_distinct_findings_make_their_findings_once(spark):
    """What makes the findings runs once, and states are as told: alarm, hit, duplicate, mismatch, unmatched."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [("a", "f", 5, [1], "R1"), ("b", "f", 6, [1], "R1"), ("c", "f", 4, [2], "R1"), ("d", "f", 90, [1], "R1"), ("e", "f", 2, [], "R9"), ("g", "f", 21, [3], "R2"), ("h", "g", 5, [7], "R1")]
    schema = "finding string, path string, line long, cwe array<int>, rule_id string"
    findings = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    expected = spark.createDataFrame([(1, "f", 5, 1, None), (2, "f", 20, 9, "R2")], "sink long, path string, line_hint long, cwe int, native_rule string")
    decoys = spark.createDataFrame([("g", 0, 10, 7)], "path string, first int, last int, cwe int")
    out = {r.finding: (r.state, r.sink) for r in evaluation.distinct_findings(findings, expected, decoys).collect()}
    assert out == {"a": ("hit", 1), "b": ("duplicate", 1), "c": ("mismatch", 1), "d": ("unmatched", None), "e": ("unmatched", None), "g": ("hit", 2), "h": ("decoy", None)}
    assert made.value == len(rows)
