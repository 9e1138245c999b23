"""Trees of files: reading, classification, skip reasons, ignore patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name endings of each language, the more special first.
LANGUAGES = {
    "typescript": [".ts", ".tsx", ".mts", ".cts"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "python": [".py", ".pyi"], "go": [".go"], "java": [".java"],
    "kotlin": [".kt", ".kts"], "ruby": [".rb"], "php": [".php"], "rust": [".rs"], "c": [".c", ".h"], "cpp": [".cc", ".cpp", ".hpp"], "csharp": [".cs"],
    "swift": [".swift"], "scala": [".scala"], "shell": [".sh", ".bash"], "yaml": [".yml", ".yaml"], "json": [".json"], "terraform": [".tf"], "dockerfile": ["dockerfile"],
}
SKIP_DIRS = ["node_modules", ".git", "__pycache__", ".venv", "venv", "site-packages", ".tox"]
BUILD_DIRS = ["dist", "build", "target", "out"]
VENDORED = ["vendor", "third_party", "vendored"]
MANIFESTS = (
    r"^(requirements[^/]*\.txt|pyproject\.toml|pipfile(\.lock)?|poetry\.lock|uv\.lock|package(-lock)?\.json|yarn\.lock|pnpm-lock\.yaml|go\.(mod|work)|cargo\.(toml|lock)"
    r"|gemfile(\.lock)?|pom\.xml|packages(\.config|\.lock\.json)|.*\.csproj|build\.gradle(\.kts)?|libs\.versions\.toml|composer\.(json|lock))$"
)
MODELS = r"\.(pkl|pickle|pt|pth|bin|h5|keras|onnx|safetensors|joblib|npy|npz|gguf)$"
MOST_BYTES = 1_000_000


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, size, content (bytes) of every file below ``root``, through Spark's own reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), "content")


def languages(name: Column) -> Column:
    """All languages of a file name, in the order of LANGUAGES."""
    low = F.lower(name)
    found = [F.when(_ends(low, ends), F.lit(lang)) for lang, ends in LANGUAGES.items()]
    return F.array_compact(F.array(*found))


def _ends(name: Column, ends: list[str]) -> Column:
    out = F.lit(False)
    for end in ends:
        out = out | (name.endswith(end) if end[0] == "." else name == end)
    return out


def glob_regex(glob: str) -> str:
    """A git-style pattern as a regular expression over relative paths: ** spans folders, * and ? don't."""
    anchored, folder = glob.startswith("/") or "/" in glob.rstrip("/"), glob.endswith("/")
    out, rest = "", glob.strip("/")
    while rest:
        if rest.startswith("**/"):
            out, rest = out + "(?:.*/)?", rest[3:]
        elif rest.startswith("**"):
            out, rest = out + ".*", rest[2:]
        else:
            out, rest = out + {"*": "[^/]*", "?": "[^/]"}.get(rest[0], re.escape(rest[0])), rest[1:]
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def ignored_by(path: Column, patterns: list[str]) -> Column:
    """Do the patterns leave a path out? The last one that matches decides; '!' lets it in again."""
    out = F.lit(False)
    for pattern in patterns:
        if not pattern.strip() or pattern.startswith("#"):
            continue
        back = pattern.startswith("!")
        out = F.when(path.rlike(glob_regex(pattern.lstrip("!"))), F.lit(not back)).otherwise(out)
    return out


def minified(text: Column) -> Column:
    """Generated code: some line of over 5,000 characters, or an average above 500."""
    lengths = F.transform(F.split(text, "\n"), lambda x: F.char_length(x))
    return (F.array_max(lengths) > 5000) | (F.char_length(text) / F.size(lengths) > 500)


def skip_reason(path: Column, size: Column, text: Column, excludes: list[str], ignore: list[str]) -> Column:
    """Why a file isn't read; NULL if it is. The first reason in this order counts."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    within = lambda names: F.arrays_overlap(folders, F.array(*map(F.lit, names)))
    return (
        F.when(within(SKIP_DIRS), "skip-dir")
        .when(within(BUILD_DIRS), "build-output")
        .when(F.exists(parts, lambda x: x.startswith(".") & (x != ".") & (x != "..")), "hidden")
        .when(ignored_by(path, ignore), "ignored")
        .when(ignored_by(path, excludes), "excluded")
        .when(size > MOST_BYTES, "oversize")
        .when(within(VENDORED), "vendored")
        .when(minified(text), "minified")
    )


def classified(files: DataFrame, excludes: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """Files (rel_path, size, text) with name, languages, kind (manifest, model, source or other) and skip_reason."""
    name = F.element_at(F.split("rel_path", "/"), -1)
    rows = files.withColumn("name", name).withColumn("languages", languages(F.col("name")))
    kind = F.when(F.lower("name").rlike(MANIFESTS), "manifest").when(F.lower("name").rlike(MODELS), "model").when(F.size("languages") > 0, "source").otherwise("other")
    return rows.withColumn("kind", kind).withColumn("skip_reason", skip_reason(F.col("rel_path"), F.col("size"), F.col("text"), excludes or [], ignore or []))


def coverage(files: DataFrame) -> DataFrame:
    """Files, and files skipped, of each first language: what wasn't read never looks clean."""
    lang = F.coalesce(F.get("languages", F.lit(0)), F.lit("none"))
    return files.groupBy(lang.alias("language"), "kind").agg(F.count("*").alias("files"), F.count("skip_reason").alias("skipped"))
