from pyspark.sql import functions as F

from sievekit.functions import labels
from sievekit.operators import gates, graph, joins


def test_gates(spark):
    files = {
        "app.py": ["import flask", "redirect('/home')", "redirect(u)", "eval(x)", "x = 1  # nosec"], "lib.py": ["a = 1", "eval(x)", "== token", "", "", "", "", "", "", "if a == b:"], "tests/test_a.py": ["import flask", "eval(q)"],
    }
    lines = spark.createDataFrame([(p, k + 1, t) for p, ts in files.items() for k, t in enumerate(ts)], "path string, line_no long, line string")
    rows = [("app.py", 2, "open-redirect"), ("app.py", 3, "open-redirect"), ("app.py", 4, "code-execution"), ("app.py", 5, "crypto"), ("lib.py", 2, "code-execution"), ("lib.py", 3, "timing"), ("lib.py", 10, "timing"),
            ("tests/test_a.py", 2, "code-execution"), ("lib.py", 1, "xss")]
    f = spark.createDataFrame([(*r, 1, 0.9, False, None, False) for r in rows], "path string, line long, category string, sev_rank int, confidence double, has_flow boolean, source_kind string, tool_param boolean")
    out = {(r.path, r.line, r.category): r for r in gates.gated(f, lines).collect()}
    assert ("app.py", 2, "open-redirect") not in out and ("app.py", 5, "crypto") not in out
    assert out["app.py", 3, "open-redirect"].sev_rank == 1 and out["app.py", 4, "code-execution"].sev_rank == 1
    assert out["lib.py", 2, "code-execution"].literal_code and out["lib.py", 1, "xss"].not_web
    assert out["lib.py", 3, "timing"].sev_rank == 1 and out["lib.py", 10, "timing"].no_auth_words
    assert (out["tests/test_a.py", 2, "code-execution"].sev_rank, out["tests/test_a.py", 2, "code-execution"].test_context) == (3, True)
    assert {r.path: r.profile for r in gates.file_facts(lines).collect()}["app.py"] == "server"


def test_labels(spark):
    row = spark.createDataFrame([("a.b.rule-1", "SQL built from CWE-89 and cwe79", "password = 'hunter22222'", "use `pkg.load()` or a.b.run(x)", "%d of %%s %-5.2f", "request.args")], "r string, t string, s string, a string, f string, o string")
    out = row.select(
        labels.bare_rule_id(F.col("r")), labels.category_of(F.col("t")), labels.cwes(F.col("t")), labels.cwe_family(labels.cwes(F.col("t"))), labels.redacted(F.col("s")),
        labels.symbols(F.col("a")), labels.format_verbs(F.col("f")), labels.numeric_only(F.col("f")), labels.origin(F.col("o"))["label"],
    ).first()
    assert tuple(out) == ("rule-1", "injection", [89, 79], "injection", "password = '<redacted>'", ["pkg.load", "a.b.run"], ["d", "f"], True, "remote")


def test_attribution_and_stores(spark):
    functions = spark.createDataFrame([("f", True, False), ("g", False, True)], "node string, has_source boolean, has_sink boolean")
    found = spark.createDataFrame([("g", 9, 0.9, 0, "late"), ("g", 3, 0.5, 1, "weak"), ("g", 3, 0.8, 2, "strong")], "node string, line int, confidence double, seq int, rule_id string")
    assert {r.node: r.sink_rule_id for r in graph.attributed_sinks(functions, found).collect()} == {"f": None, "g": "strong"}
    channels = spark.createDataFrame([("orm", "k", "write", "f"), ("orm", "k", "read", "g"), ("orm", "j", "read", "g")], "kind string, key string, role string, fn_id string")
    assert [(r.writer, r.reader, r.key) for r in graph.persistent_flows(functions, channels).collect()] == [("f", "g", "k")]


def test_zip_and_reported(spark):
    asked = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "batch int, items array<string>")
    answers = spark.createDataFrame([(1, [["x"], []]), (2, None)], "batch int, results array<array<string>>")
    assert {r.item: r.result for r in joins.zipped(asked, answers).collect()} == {"a": ["x"], "b": [], "c": None}
    f = spark.createDataFrame([("p", 10, [1]), ("p", 12, [2]), ("p", 13, [1]), ("p", 14, [1])], "path string, line int, cwe array<int>")
    r = spark.createDataFrame([("p", 10, [1])], "path string, line int, cwe array<int>")
    assert sorted(x.line for x in joins.not_yet_reported(f, r).collect()) == [12, 14]
