import itertools
import random

from pyspark.sql import functions as F

from sievekit.functions import text as T
from sievekit.operators import clusters, evaluation, findings, joins, lines


def test_clusters_split_beyond_the_gap_and_keep_the_first_best(spark):
    rows = spark.createDataFrame([("f", 1, 0.5, 0), ("f", 6, 0.9, 1), ("f", 12, 0.9, 2), ("f", 17, 0.9, 3)], "path string, line int, confidence double, seq int")
    out = clusters.gap_clusters(rows, ["path"], "line", 5, [F.col("confidence").desc(), F.col("seq")]).orderBy("line").collect()
    assert [(r.line, r.cluster_start, r.cluster_end, r.occurrence_count) for r in out] == [(6, 1, 6, 2), (12, 12, 17, 2)]


def test_occurrences_are_numbered(spark):
    rows = spark.createDataFrame([("x", 2), ("x", 1), ("y", 3)], "base string, line int")
    out = {r.line: (r.ordinal, r.fingerprint) for r in clusters.occurrence_ids(rows, "base", "line").collect()}
    assert out[1] == (0, "x") and out[3] == (0, "y") and out[2][0] == 1 and len(out[2][1]) == 64


def test_statements_follow_brackets_and_never_go_below_zero(spark):
    text = ["a(", "b", ")", ")", "c", "d[", "]"]
    rows = spark.createDataFrame([("f", k + 1, t) for k, t in enumerate(text)], "path string, line_no long, line string")
    out = [r.stmt_id for r in lines.statements(rows, "path").orderBy("line_no").collect()]
    depth, stmt, expected = 0, 0, []
    for t in text:
        expected.append(stmt)
        depth = max(0, depth + sum(t.count(c) for c in "([{") - sum(t.count(c) for c in ")]}"))
        stmt += depth == 0
    assert out == expected


def test_rules_negatives_suppressions_and_secrets(spark):
    rows = spark.createDataFrame(
        [(1, "eval(x)"), (2, "eval(x)  # nosec"), (3, "safe_eval(x)"), (4, 'key = "aB3dE5gH7jK9mN1p"'), (5, 'key = "xxxxxxxxxxxxxxxx"'), (6, 'key = os.environ["A"]')],
        "line_no int, line string",
    )
    rules = [
        {"rule_id": "E", "patterns": [r"eval\("], "not": ["safe_eval"]},
        {"rule_id": "NS-SECRET-1", "patterns": ['"[A-Za-z0-9]{16}"', "key ="], "secret": True, "every": True},
    ]
    out = {(r.line_no, r.rule_id, r.pattern_no) for r in lines.rule_hits(rows, rules).collect()}
    assert (1, "E", 0) in out and not any(k == 2 or (k == 3 and r == "E") for k, r, _ in out)
    assert (4, "NS-SECRET-1", 0) in out and not any(k in (5, 6) and p == 0 for k, _, p in out)


def test_all_line_breaks(spark):
    text = "a\r\nb\nc\rd\x0be\x0cf\x85g\u2028h\u2029i"
    rows = spark.createDataFrame([(1, text)], "id int, t string")
    assert [r.line for r in lines.lines_of(rows, "id", "t").orderBy("line_no").collect()] == text.splitlines()


def test_entropy_and_placeholders(spark):
    rows = spark.createDataFrame([("",), ("aaaa",), ("abcd",)], "t string")
    assert [r[0] for r in rows.select(T.entropy(F.col("t"))).collect()] == [0.0, 0.0, 2.0]
    assert rows.filter(T.is_placeholder(F.col("t")) & (F.col("t") != "")).first().t == "aaaa"


def _apart(a, b):
    """Damerau-Levenshtein (adjacent swaps) of exactly one, by trying every edit."""
    letters = set(a + b)
    made = {a[:k] + a[k + 1 :] for k in range(len(a))}
    made |= {a[:k] + c + a[k:] for k in range(len(a) + 1) for c in letters}
    made |= {a[:k] + c + a[k + 1 :] for k in range(len(a)) for c in letters}
    made |= {a[:k] + a[k + 1] + a[k] + a[k + 2 :] for k in range(len(a) - 1)}
    return a != b and b in made


def test_one_edit_apart_against_all_edits(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    rows = spark.createDataFrame(list(itertools.product(words, words)), "a string, b string")
    for r in rows.select("a", "b", T.one_edit_apart(F.col("a"), F.col("b")).alias("x")).collect():
        assert r.x == _apart(r.a, r.b), (r.a, r.b)


def test_confidence_model(spark):
    rows = spark.createDataFrame([(0,), (2,), (9,)], "h int")
    assert [r[0] for r in rows.select(findings.hop_confidence(F.col("h"), "cross-file")).collect()] == [0.75, 0.55, 0.25]
    assert [r[0] for r in rows.select(findings.hop_confidence(F.col("h"), "taint")).collect()] == [0.9, 0.74, 0.65]


def test_views(spark):
    cases = [
        (([117], "taint-flow", 0, "xss"), (False, False)), (([117, 79], "taint-flow", 0, "xss"), (True, True)), (([], "pattern-only", 1, "xss"), (True, False)),
        (([], "pattern-only", 2, "xss"), (True, False)), (([], "pattern-only", 2, "config"), (False, False)), (([], "self-evident", 2, "secrets"), (True, True)),
        (([], "engine", 3, "xss"), (False, False)),
    ]
    rows = spark.createDataFrame(
        [(*c, False, "legacy", None, False, False) for c, _ in cases],
        "cwe array<int>, tier string, sev_rank int, category string, unconfirmed boolean, engine string, reachability string, inventory_rule boolean, dangerous_rule boolean",
    )
    assert [tuple(r) for r in rows.select(findings.in_view(False), findings.in_view(True)).collect()] == [e for _, e in cases]


def test_thresholds_drop_and_cap(spark):
    rows = spark.createDataFrame([("off", 0.9, 0, False), ("low", 0.2, 0, False), ("cap", 0.9, 0, False), ("cap", 0.9, 0, True), ("free", 0.1, 1, False)], "rule_id string, confidence double, sev_rank int, has_flow boolean")
    t = spark.createDataFrame([("off", False, None, None), ("low", True, 0.5, None), ("cap", True, None, 3)], "rule_id string, enabled boolean, min_confidence double, max_rank int")
    assert sorted((r.rule_id, r.has_flow, r.sev_rank) for r in findings.with_thresholds(rows, t).collect()) == [("cap", False, 3), ("cap", True, 0), ("free", False, 1)]


def _merge_one_by_one(rows):
    kept = []
    for rule, rank, flow, cwe in sorted(rows, key=lambda r: (not r[2], r[1], r[0], r[3])):
        for other in kept:
            if other[0] != rule and other[3] & set(cwe):
                other[3] |= set(cwe)
                other[4].add(rule)
                break
        else:
            kept.append([rule, rank, flow, set(cwe), set()])
    return sorted((r, k, f, tuple(sorted(c)), tuple(sorted(a))) for r, k, f, c, a in kept)


def test_same_sink_merge_depends_on_order(spark):
    rng = random.Random(5)
    groups = {("f", n): [(f"R{rng.randint(0, 4)}", rng.randint(0, 3), rng.random() < 0.3, sorted(rng.sample(range(1, 6), rng.randint(0, 2)))) for _ in range(rng.randint(1, 6))] for n in range(60)}
    rows = spark.createDataFrame([(p, n, *r) for (p, n), rs in groups.items() for r in rs], "path string, line int, rule_id string, sev_rank int, has_flow boolean, cwe array<int>")
    found: dict = {}
    for r in findings.merge_same_sink(rows).collect():
        found.setdefault((r.path, r.line), []).append((r.rule_id, r.sev_rank, r.has_flow, tuple(r.cwe), tuple(r.absorbed)))
    assert {k: sorted(v) for k, v in found.items()} == {k: _merge_one_by_one(v) for k, v in groups.items()}


def test_rule_groups_merge_neighbours(spark):
    rows = spark.createDataFrame([("f", 1, "A", 2), ("f", 3, "B", 1), ("f", 6, "A", 2), ("f", 1, "C", 0)], "path string, line int, rule_id string, sev_rank int")
    out = sorted((r.line, r.rule_id, r.duplicate_rule_ids) for r in findings.merged_rule_groups(rows, {"A": "g", "B": "g"}).collect())
    assert out == [(1, "C", []), (3, "B", ["A"]), (6, "A", [])]


def test_ignore_entries_expire(spark):
    rows = spark.createDataFrame([("p", "R", "a/x.py"), ("q", "R", "b/x.py"), ("r", "S", "a/y.py")], "fingerprint string, rule_id string, path string")
    entries = spark.createDataFrame([("q", None, None, None), (None, "R", "^a/", "2020-01-01"), (None, "S", "^a/", "2999-01-01")], "fingerprint string, rule_id string, path_regex string, expires string")
    assert {r.fingerprint for r in findings.without_ignored(rows, entries, F.lit("2024-01-01").cast("date")).collect()} == {"p"}


def test_demotion_never_raises(spark):
    rows = spark.createDataFrame([(1, 0.9), (4, 0.1)], "sev_rank int, confidence double")
    assert sorted((r.sev_rank, r.confidence) for r in findings.demoted(rows, F.lit(True), 3, 0.4, "m").collect()) == [(3, 0.4), (4, 0.1)]


def test_innermost_scope_and_nearest_assignment(spark):
    points = spark.createDataFrame([(1, "f", 5), (2, "f", 50)], "point_id int, k string, at int")
    scopes = spark.createDataFrame([("f", 1, 20, "outer"), ("f", 4, 8, "inner")], "k string, b int, e int, name string")
    assert {r.point_id: r.name for r in joins.innermost(points, scopes, "k", "at", "b", "e", ["name"]).collect()} == {1: "inner", 2: None}
    p = spark.createDataFrame([("v", 5), ("v", 9), ("w", 1)], "var string, at int")
    m = spark.createDataFrame([("v", 5, "a"), ("v", 7, "b")], "var string, at int, rhs string")
    assert {(r["var"], r["at"]): r.rhs for r in joins.latest_before(p, m, ["var"], "at", "rhs").collect()} == {("v", 5): "a", ("v", 9): "b", ("w", 1): None}


def test_parameter_binding(spark):
    rows = spark.createDataFrame([(["self", "a", "b"], 0, None), (["a", "b"], 1, None), (["a", "b"], 0, "b"), (["a"], 3, None), (["a"], 0, "z")], "params array<string>, pos int, kw string")
    assert [r[0] for r in rows.select(joins.bound_parameter(F.col("params"), F.col("pos"), F.col("kw"))).collect()] == [1, 1, 1, None, None]


def test_near_lines_include_the_edge(spark):
    found = spark.createDataFrame([("f", 10, 79), ("f", 25, 79), ("f", 26, 79), ("f", 12, 80)], "path string, line int, cwe int")
    hints = spark.createDataFrame([("s", "f", 10, 79)], "sink_id string, path string, line_hint int, cwe int")
    assert sorted(r.line for r in joins.near_lines(found, hints, 15).collect()) == [10, 25]


def test_interfaces_and_sole_owners(spark):
    i = spark.createDataFrame([("I", "m"), ("I", "n")], "interface string, method string")
    t = spark.createDataFrame([("T", "m"), ("T", "n"), ("U", "m")], "type string, method string")
    assert [tuple(r) for r in joins.implementers(i, t).collect()] == [("I", "T")]
    calls = spark.createDataFrame([(1, "m"), (2, "n")], "id int, method string")
    assert [r.id for r in joins.sole_owners(calls, t, 1).collect()] == [2]


def test_evaluation(spark):
    rows = spark.createDataFrame([("g", True, True), ("g", True, False), ("g", False, True), ("h", False, False)], "pool string, predicted boolean, truth boolean")
    out = {r.pool: (r.precision, r.recall) for r in evaluation.quality_of(rows, "pool").collect()}
    assert out == {"g": (0.5, 0.5), "h": (None, None)}
    cases = spark.createDataFrame([(1, "a", "R", "c", 79), (2, "b", "Q", "c", 79), (3, "z", "Q", "c", 1)], "case_id int, path string, rule_id string, category string, cwe int")
    found = spark.createDataFrame([("a", "R", "x", [1]), ("b", "Z", "x", [79])], "path string, rule_id string, category string, cwe array<int>")
    assert {r.case_id: r.credit for r in evaluation.credited(cases, found).collect()} == {1: "rule", 2: "cwe", 3: None}
    pairs = spark.createDataFrame([(1, False, True), (1, True, False), (2, False, True), (2, True, True)], "case_id int, fixed boolean, hit boolean")
    assert {r.case_id: (r.detected, r.clean_after_fix) for r in evaluation.pairs_hold(pairs).collect()} == {1: (True, True), 2: (True, False)}


def test_token_entropy_of_repeated_and_missing_ids(spark, tmp_path):
    import duckdb

    from sievekit.plans import findings as plans

    rows = [(1, "aab longest1"), (1, "aaaaaaaaaaaaaaab"), (2, None), (2, "x"), (None, "lost words"), (3, "?!"), (3, "?!")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.sql(plans.ORACLES["token_entropy"]).fetchall()
    assert sorted(map(repr, map(tuple, plans.token_entropy(spark, str(tmp_path)).collect()))) == sorted(map(repr, wanted))
