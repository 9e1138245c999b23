import pytest
from pyspark.sql import functions as F

from sievekit.operators import dependencies, reports, versions


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("1.2.3", [1, 2, 3]), ("v2.0", [2, 0]), ("1.0rc1", [1, 0, -1]), ("1.0.0-beta+x", [1, 0, 0, -1]), ("1!2.0", None), ("0!2.0", [2, 0]), ("abc", None), ("1.0.DEV3", [1, 0, -1]), ("1.0.post2", [1, 0]),
        ("1.2.3.4.5.6.7", [1, 2, 3, 4, 5, 6, 7]), ("20240101123000", [20240101123000]), ("3000000000.1", [3000000000, 1]), ("1.99999999999999999999", None), ("000000000000000000001", [1]), (" 1 ", [1]), ("1.", [1]),
    ],
)
def test_version(spark, text, parts):
    assert spark.createDataFrame([(text,)], "t string").select(versions.version(F.col("t"))).first()[0] == parts


@pytest.mark.parametrize(
    ("spec", "version", "ok"),
    [
        ("^1.2.3", "1.9", True), ("^1.2.3", "2.0", False), ("^0.2.3", "0.3.0", False), ("~1.2", "1.2.9", True), ("~1.2", "1.3", False), ("~=1.4.2", "1.4.9", True),
        ("~=1.4.2", "1.5", False), (">=1,<2", "1.5", True), (">= 1.0 < 2", "2.0", False), ("1.0 - 2.0", "2.0", True), ("1.0", "1.0.0", True), ("1.0", "1.0.1", False),
        ("*", "9", None), ("", "1", None), (">=1 || <0", "1", None), ("!=1", "1", False), ("!=1", "2", True), ("nope", "1", None), (">1.2", "1.2.0.0", False), ("<1.0", "1.0rc1", True),
        ("^0.0.3", "0.0.9", True), ("^0.0.3", "0.1", False), ("^0.0.3", "0", False), ("<=1.2", "1.2.1", False), ("~1", "1.9", True), ("=1.0", "1.0", None), (">=2,nope", "1", False), ("nope,>=2", "1", None),
        ("~=1.0.0", "1", False), ("1.2.*", "1.2", True), (">=1.0 && <2", "1.5", True),
        (">=3000000000.1", "1.0", False), (">=1.2", "3000000000.0", True), (">=20240101123000", "20230101", False), ("1.2.3.4.5.6.7", "1.2.3.4.5.6.8", False), ("1.2.3.4.5.6.7", "1.2.3.4.5.6.7.0", True),
        (">=1.99999999999999999999", "1", None), ("^", "1", None), (">=v1", "1", None), (">= ,1", "1", None), ("1.0 - x", "1", None),
    ],
)
def test_ranges(spark, spec, version, ok):
    row = spark.createDataFrame([(spec, version)], "s string, v string")
    assert row.select(versions.includes(F.col("s"), F.col("v"))).first()[0] is ok


TOP, LEAST = versions.HIGH, versions.LOW


@pytest.mark.parametrize(
    ("spec", "lo", "hi"),
    [
        ("1.2", [1, 2], [1, 3]), ("==1.2", [1, 2], [1, 3]), ("1.2.*", [1, 2], [1, 3]), ("<=1.2", LEAST, [1, 3]), ("<1.2", LEAST, [1, 2]), (">1.2", [1, 2, 1], TOP), (">=1.2", [1, 2], TOP),
        ("^1.2", [1, 2], [2]), ("^0.2.3", [0, 2, 3], [0, 3]), ("^0.0.3", [0, 0, 3], [0, 1]), ("~1.2.3", [1, 2, 3], [1, 3]), ("~1", [1], [2]), ("~=1.4.2", [1, 4, 2], [1, 5]), ("~=1", [1], [2]),
        ("!=1.0", LEAST, TOP), (">=1,!=1.5,<2", [1], [2]), ("1.0 - 2.0", [1], [2, 1]), ("==1.0rc1", [1, 0, -1], [1]), ("*", None, None), ("", None, None), ("1 || 2", None, None), ("=1", None, None), ("1.2.3.4.5.6.7", [1, 2, 3, 4, 5, 6, 7], [1, 2, 3, 4, 5, 6, 8]), (">=3000000000", [3000000000], TOP),
    ],
)
def test_intervals(spark, spec, lo, hi):
    found = spark.createDataFrame([(spec,)], "s string").select(versions.interval(F.col("s"))).first()[0]
    bare = lambda x: x[: max((k + 1 for k, n in enumerate(x) if n), default=1)]
    assert (found if found is None else (bare(found.lo), bare(found.hi))) == (None if lo is None else (lo, hi))


def test_entries_of_the_package_alone_or_all(spark):
    affected = spark.createDataFrame([("A", "PyPI", "foo.bar", 1), ("A", "PyPI", "other", 2), ("B", "Go", "x/v2", 3)], "advisory_id string, ecosystem string, package string, affected int")
    matches = spark.createDataFrame([("pypi", "Foo_Bar", "A"), ("Go", "x", "B")], "ecosystem string, package string, advisory_id string")
    assert sorted((r.package, r.affected) for r in versions.scoped(matches, affected).collect()) == [("Foo_Bar", 1), ("x", 3)]


def test_spellings_of_a_package_meet_and_unread_events_stay(spark):
    events = "advisory_id string, ecosystem string, package string, events array<struct<introduced:string,fixed:string,last_affected:string>>"
    advisories = spark.createDataFrame([("A", "PyPI", "foo-bar", [(None, "1.2", None)]), ("B", "PyPI", "foo-bar", [("x", None, None)]), ("C", "PyPI", "foo-bar", [])], events)
    packages = spark.createDataFrame([("pypi", "Foo_Bar", "==1.1"), ("pypi", "foo.bar", "==1.2")], "ecosystem string, package string, spec string")
    out = {(r.package, r.advisory_id): r.confidence for r in versions.vulnerable(packages, versions.advisory_intervals(advisories)).collect()}
    assert out == {("Foo_Bar", "A"): 1.0, ("Foo_Bar", "B"): 0.5, ("Foo_Bar", "C"): 0.5, ("foo.bar", "B"): 0.5, ("foo.bar", "C"): 0.5}


def test_advisories_pair_events_and_keep_the_unknown(spark):
    advisories = spark.createDataFrame(
        [("A", "npm", "p", [("0", None, None), (None, "1.2", None), ("2.0", None, None), (None, None, "2.3")])],
        "advisory_id string, ecosystem string, package string, events array<struct<introduced:string,fixed:string,last_affected:string>>",
    )
    packages = spark.createDataFrame([("p", "npm", s) for s in ("1.1", "1.2", "2.3", "2.4", "a || b")], "package string, ecosystem string, spec string")
    out = {r.spec: r.confidence for r in versions.vulnerable(packages, versions.advisory_intervals(advisories)).collect()}
    assert out == {"1.1": 1.0, "2.3": 1.0, "a || b": 0.5}


@pytest.mark.parametrize(("current", "fix"), [("1.2", "1.3"), ("==1.3", "1.10"), (">=1", "1.1"), ("2", None)])
def test_lowest_fix(spark, current, fix):
    row = spark.createDataFrame([(current, ["1.10", "1.3", "1.1", "odd"])], "v string, f array<string>")
    assert row.select(versions.lowest_fix(F.col("v"), F.col("f"))).first()[0] == fix


@pytest.mark.parametrize(
    ("vector", "score"),
    [("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1), ("CVSS:3.1/AV:P/AC:H/PR:H/UI:R/S:U/C:N/I:N/A:N", 0.0), ("CVSS:3.1/AV:N", None)],
)
def test_cvss3(spark, vector, score):
    assert spark.createDataFrame([(vector,)], "v string").select(versions.cvss3(F.col("v"))).first()[0] == score


def test_imitations(spark):
    names = spark.createDataFrame([(n,) for n in ("reqeusts", "request", "requests", "numpi", "numpyy", "flask")], "name string")
    popular = spark.createDataFrame([("requests",), ("numpy",)], "name string")
    assert {r.name: r.popular for r in dependencies.imitations(names, popular).collect()} == {"reqeusts": "requests", "request": "requests", "numpi": "numpy", "numpyy": "numpy"}


def test_undeclared(spark):
    imports = spark.createDataFrame([(m,) for m in ("os", "yaml", "mine", "ghost", "my_pkg")], "module string")
    declared = spark.createDataFrame([("PyYAML",), ("my-pkg",)], "name string")
    local = spark.createDataFrame([("mine",)], "module string")
    assert [r.module for r in dependencies.undeclared(imports, declared, ["os"], local, {"yaml": "pyyaml"}).collect()] == ["ghost"]


def test_lock_files_shadow_manifests(spark):
    files = spark.createDataFrame([("a", "package.json", 5), ("a", "package-lock.json", 9), ("b", "package.json", 5), ("b", "package-lock.json", 0)], "dir string, name string, size int")
    out = {(r.dir, r.name) for r in dependencies.without_shadowed(files, {"package.json": ["package-lock.json"]}).collect()}
    assert out == {("a", "package-lock.json"), ("b", "package.json"), ("b", "package-lock.json")}


def test_chains_and_inventory(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "caller string, callee string")
    out = {r.node: r.chain for r in dependencies.chains(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert out == {"a": ["a"], "b": ["a", "b"], "c": ["a", "c"], "d": ["a", "c", "d"]}
    rows = spark.createDataFrame([("npm", "x", "1", "b.json", ["y", "x"], False), ("npm", "x", "1", "a.json", ["x"], True)], "ecosystem string, name string, version string, file string, chain array<string>, direct boolean")
    (row,) = dependencies.inventory(rows).collect()
    assert (row.files, row.chain, row.direct) == (["a.json", "b.json"], ["x"], True)


def test_reachable_symbols(spark):
    a = spark.createDataFrame([("1", "p", "load"), ("2", "p", "p.sub.run"), ("3", "q", "load")], "advisory_id string, package string, symbol string")
    calls = spark.createDataFrame([("p.io.load",), ("p.sub.run",)], "symbol string")
    assert {r.advisory_id: r.reachability for r in dependencies.reachable_symbol(a, calls).collect()} == {"1": "reachable", "2": "reachable", "3": "unknown"}


def test_reports(spark):
    rows = spark.createDataFrame([("PyPI", "a", "1"), ("PyPI", "a", "1"), ("Maven", "g:b", "")], "ecosystem string, name string, version string")
    assert sorted(r.bom_ref for r in reports.bill_of_materials(rows).collect()) == ["pkg:maven/g/b", "pkg:pypi/a@1", "pkg:pypi/a@1#2"]
    f = spark.createDataFrame([("X", 1, "p", 0, "m", [("p", 3, "s")], "legacy")], "rule_id string, sev_rank int, path string, line int, message string, flow array<struct<path:string,line:int,snippet:string>>, engine string")
    assert '"ruleId":"X"' in reports.sarif_results(f).first().value and '"severity":"high"' in reports.json_findings(f).first().value
    v = spark.createDataFrame([("A", "npm", "x", "1", None)], "advisory_id string, ecosystem string, name string, version string, reachability string")
    assert reports.exploitability(v).first().status == "under_investigation"
    passes = spark.createDataFrame([("scan", "completed"), ("sca", "failed")], "name string, status string")
    assert reports.exit_status(f, passes, True).first().status == 2


def test_overlaps_are_told_once_for_each_class(spark, monkeypatch):
    """The pairs that are judged grow with different ranges and windows, not with packages and advisories."""
    written, cut = [], versions.cut
    monkeypatch.setattr(versions, "cut", lambda df: (written.append((out := cut(df)).count()), out)[1])
    specs = ["==1.0", ">=2", None]
    packages = spark.createDataFrame([(k, "pypi", "a_b", specs[k % 3]) for k in range(60)], "k long, ecosystem string, package string, spec string")
    event = "events array<struct<introduced:string,fixed:string,last_affected:string>>"
    advisories = spark.createDataFrame([(k, "PyPI", "A.b", [("1", None, None), (None, "1.5", None)]) for k in range(1200)], f"advisory_id long, ecosystem string, package string, {event}")
    out = {(r.k, r.advisory_id): r.confidence for r in versions.vulnerable(packages, versions.advisory_intervals(advisories)).collect()}
    assert out == {(k, a): (1.0, None, 0.5)[k % 3] for k in range(60) if k % 3 != 1 for a in range(1200)}
    assert sorted(written) == [2, 1200]


def test_packages_are_not_shuffled_by_class(spark):
    """Where tables are too large for the planner to send whole, advisories still meet the packages as they lie."""
    packages = spark.createDataFrame([(k, "pypi", "a_b", ["==1.0", ">=2", None][k % 3]) for k in range(9)], "k long, ecosystem string, package string, spec string")
    event = "events array<struct<introduced:string,fixed:string,last_affected:string>>"
    advisories = spark.createDataFrame([(k, "PyPI", "A.b", [("1", None, None), (None, "1.5", None)]) for k in range(4)], f"advisory_id long, ecosystem string, package string, {event}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = versions.vulnerable(packages, versions.advisory_intervals(advisories))
        plan = out._jdf.queryExecution().executedPlan().toString()
        found = {(r.k, r.advisory_id): r.confidence for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert found == {(k, a): (1.0, None, 0.5)[k % 3] for k in range(9) if k % 3 != 1 for a in range(4)}


def test_scoped_totals_are_those_of_scoped(spark):
    matches = [(a, "PyPI", f"Pkg_{k}") for a in range(4) for k in range(7)]
    entries = [(a, "pypi", f"pkg.{k}", n) for a in range(3) for k in range(0, 7, 3) for n in range(a + k + 1)]
    m = spark.createDataFrame(matches, "advisory_id long, ecosystem string, package string")
    e = spark.createDataFrame(entries, "advisory_id long, ecosystem string, package string, affected int")
    rows = versions.scoped(m, e).groupBy("advisory_id", "package").agg({"affected": "sum", "*": "count"}).collect()
    wanted = {(r[0], r[1]): (r["count(1)"], r["sum(affected)"]) for r in rows}
    assert {(r.advisory_id, r.package): (r.entries, r.total) for r in versions.scoped_totals(m, e).collect()} == wanted
