from pyspark.sql import functions as F

from sievekit.functions import unicode
from sievekit.sources import files, manifests, python_facts, rules


def test_classification_and_skip_reasons(spark):
    rows = [("src/a.py", 1, "x"), ("node_modules/a.js", 1, "x"), ("build/a.js", 1, "x"), (".hid/a.py", 1, "x"), ("keep.log", 1, "x"), ("drop.log", 1, "x"), ("src/tests/b.py", 1, "x"),
            ("big.py", 5_000_000, "x"), ("vendor/a.go", 1, "x"), ("min.js", 1, "x" * 6000), ("package.json", 1, "{}"), ("m.pkl", 1, ""), ("Dockerfile", 1, "FROM x")]
    df = spark.createDataFrame(rows, "rel_path string, size long, text string")
    out = {r.rel_path: r for r in files.classified(df, excludes=["src/tests/**"], ignore=["*.log", "!keep.log"]).collect()}
    assert {p: r.skip_reason for p, r in out.items() if r.skip_reason} == {
        "node_modules/a.js": "skip-dir", "build/a.js": "build-output", ".hid/a.py": "hidden", "drop.log": "ignored", "src/tests/b.py": "excluded", "big.py": "oversize", "vendor/a.go": "vendored", "min.js": "minified",
    }
    assert (out["package.json"].kind, out["m.pkl"].kind, out["src/a.py"].kind, out["Dockerfile"].languages) == ("manifest", "model", "source", ["dockerfile"])
    assert sum(r.files for r in files.coverage(files.classified(df)).collect()) == len(rows)


def test_tree_is_read_by_spark(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b.py").write_text("print(1)\n")
    (row,) = files.read_tree(spark, str(tmp_path)).collect()
    assert row.path.endswith("a/b.py") and bytes(row.content) == b"print(1)\n"


def test_rules_are_parsed():
    text = """
rules:
  - {id: A, severity: ERROR, patterns: ["x", "(", 3], pattern-not: ["y"], cwe: ["CWE-79"]}
  - {id: T, mode: taint, patterns: ["x"]}
  - {id: B, severity: odd, patterns: "x"}
"""
    (rule,) = rules.parse_rules(text)
    assert (rule["rule_id"], rule["rank"], rule["patterns"], rule["not"], rule["cwe"], rule["category"]) == ("A", 1, ["x"], ["y"], [79], "general")


def test_settings(spark):
    (t,) = rules.thresholds_table(spark, "rules: {R: {enabled: false, min_confidence: 0.5, max_severity: low}}").collect()
    assert tuple(t) == ("R", False, 0.5, 3)
    (i,) = rules.ignore_table(spark, "ignore: [{rule_id: R, path: 'a/*.py', expires: 2030-01-01}]").collect()
    assert i.expires == "2030-01-01" and i.path_regex.startswith("^a/")
    assert rules.baseline_table(spark, '{"fingerprints": ["b", "a", "b"]}').count() == 2


def test_manifests(spark):
    texts = {
        "requirements.txt": "a==1.0  # c\nb>=2 ; python_version<'3'\n-r x\n", "package.json": '{"dependencies": {"l": "^1"}}', "x/package.json": "{", "go.mod": "require github.com/x/y v1.2.0 // indirect\n",
        "package-lock.json": '{"packages": {"": {"dependencies": {"a": "1"}}, "node_modules/a": {"version": "1"}, "node_modules/a/node_modules/b": {"version": "2"}}}',
        "Cargo.lock": '[[package]]\nname = "s"\nversion = "1.1"\n', "pom.xml": '<project xmlns="http://m"><properties><v>3</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>h</artifactId><version>${v}</version></dependency></dependencies></project>',
        "composer.json": '{"require": {"php": "8", "a/b": "^1"}}', "Gemfile.lock": "GEM\n  specs:\n    rake (13.0)\n\nDEPENDENCIES\n  rake\n", "yarn.lock": 'left@^1.0:\n  version "1.3"\n', "Pipfile.lock": "{}",
    }
    df = spark.createDataFrame(list(texts.items()), "path string, text string")
    out = [(r.path, r.ecosystem, r.name, r.version, r.direct) for r in manifests.packages(df).collect()]
    assert ("requirements.txt", "PyPI", "a", "==1.0", True) in out and ("requirements.txt", "PyPI", "b", ">=2", True) in out
    assert ("package-lock.json", "npm", "b", "2", False) in out and ("package-lock.json", "npm", "a", "1", True) in out
    assert ("pom.xml", "Maven", "g:h", "3", True) in out and ("go.mod", "Go", "github.com/x/y", "v1.2.0", False) in out
    assert ("Cargo.lock", "crates.io", "s", "1.1", False) in out and ("composer.json", "Packagist", "a/b", "^1", True) in out
    assert ("Gemfile.lock", "RubyGems", "rake", "13.0", True) in out and ("yarn.lock", "npm", "left", "1.3", False) in out
    status = {r.path: r.status for r in manifests.packages(df).collect()}
    assert status["x/package.json"].startswith("failed") and status["Pipfile.lock"] == "empty"


def test_python_facts(spark):
    text = "import os as o\nfrom m import f\nclass A(B):\n    def go(self, q):\n        if not q:\n            return\n        x = q\n        return f(x, k=1)\n"
    df = spark.createDataFrame([("a.py", text), ("b.py", "def (")], "path string, text string")
    rows = python_facts.python_facts(df).collect()
    facts = {(r.fact, r.name): r for r in rows}
    assert facts["import", "o"].target == "os" and facts["import", "f"].target == "m:f" and facts["class", "A"].params == ["B"]
    assert facts["function", "go"].params == ["self", "q"] and facts["call", "f"].slots == ["0"] and facts["call", "f"].owner == "A.go"
    assert ("guard", "q") in facts and ("returned_call", "f") in facts and facts["file", None].status.startswith("failed")


def test_hidden_text(spark):
    hidden = "".join(chr(0xE0000 + ord(c)) for c in "Ignore all")
    df = spark.createDataFrame([("a\u200bb" + hidden,), ("plain",)], "t string")
    assert [r[0] for r in df.select(unicode.decoded(F.col("t"))).collect()] == ["abIgnore all", "plain"]
    assert [r[0] for r in df.select(unicode.visible(F.col("t"))).collect()] == ["ab", "plain"]
    assert [r[0] for r in df.select(unicode.smuggled(F.col("t"), "Ignore all")).collect()] == [True, False]
