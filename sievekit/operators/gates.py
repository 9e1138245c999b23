"""Context gates: what a file imports and what stands near a line lowers findings that lack an attacker or a danger.

Word lists are this library's own; each gate is a row of GATES, in the order in which it applies. Facts are made
once from the lines of all files (one aggregate, one window), then joined to the findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.operators.findings import demoted
from sievekit.operators.lines import context

#: Imports that tell what a file is for.
FILE_WORDS = {
    "web": r"^\s*(from|import)\s+(flask|django|fastapi|starlette|aiohttp|tornado|bottle|sanic|quart)\b|require\(['\"](express|koa|fastify|hapi)['\"]\)|net/http|gin-gonic",
    "ai": r"^\s*(from|import)\s+(openai|anthropic|transformers|torch|langchain|llama_index|tensorflow|vllm|huggingface_hub)\b",
    "archive": r"^\s*(from|import)\s+(tarfile|zipfile|shutil|rarfile)\b|archive/(tar|zip)",
}
#: Words near a line, with the number of lines to either side.
LINE_WORDS = {
    "archive_near": (r"\b(extractall|extract|unpack_archive|getmembers|ZipFile|TarFile)\b", 2),
    "config_url": (r"\b(settings|config|environ|getenv|BASE_URL|API_URL)\b", 2),
    "uuid": (r"\buuid[1-5]?\b|\bUUID\(", 3),
    "trusts_remote": (r"trust_remote_code\s*=\s*True", 2),
    "auth_words": (r"\b(password|token|secret|signature|hmac|digest|api_?key)\b", 5),
    "weights_only": (r"weights_only\s*=\s*True", 2),
    "literal_eval": (r"\b(eval|exec)\(\s*['\"]", 0),
    "log_words": (r"\b(log|logger|logging)\.\w+\(\s*['\"][^{%]*['\"]\s*\)", 0),
    "static_redirect": (r"redirect\(\s*['\"][^{}%+]*['\"]\s*\)", 0),
    "denylist": (r"\b(deny|block|black)_?list\b|\bforbidden\b", 0),
    "suppressed": (r"#\s*nosec\b|//\s*nosec\b|nosemgrep", 0),
}
TEST_PATHS = r"(^|/)(tests?|__tests__|spec|fixtures|testdata)/|(^|/)(test_[^/]*|[^/]*_test|[^/]*\.(test|spec))\.[a-z]+$|(^|/)conftest\.py$"
MIGRATIONS = r"(^|/)(migrations?|alembic)/"
CHECKERS = r"(^|/)(security|sanitiz\w*|valid(at\w*)?|filters?)[^/]*\.[a-z]+$"


@dataclass(frozen=True)
class Gate:
    mark: str
    when: Column
    rank: int = 4
    confidence: float = 0.3
    drop: bool = False


def gates() -> list[Gate]:
    c, category = F.col, F.col("category")
    return [
        Gate("test_context", c("path").rlike(TEST_PATHS) & ~c("path").rlike(r"(^|/)examples?/"), 3, 0.4),
        Gate("no_attacker_context", (c("source_kind") == "operator") & ~F.coalesce(c("tool_param"), F.lit(False)), 3, 0.3),
        Gate("not_ai", (category == "ai") & ~c("ai")),
        Gate("not_web", category.isin("xss", "csrf", "ssrf", "open-redirect") & ~c("web") & ~c("path").rlike(r"\.(html?|jsx|tsx|vue|erb|ejs)$")),
        Gate("not_archive", (category == "zip-slip") & ~c("archive") & ~c("archive_near")),
        Gate("config_url", (category == "ssrf") & c("config_url"), 4, 0.2),
        Gate("uuid_target", (category == "injection") & c("uuid") & ~c("web"), 4, 0.2),
        Gate("descriptive_log", (category == "logging") & c("log_words"), 4, 0.1),
        Gate("plain_pretrained", (category == "model-load") & ~c("trusts_remote"), 4, 0.2),
        Gate("literal_code", (category == "code-execution") & (c("literal_eval") | ~c("web")), 3, 0.3),
        Gate("denylist_entry", c("denylist") & ~c("has_flow"), 4, 0.2),
        Gate("migration", (category == "injection") & c("path").rlike(MIGRATIONS), 4, 0.2),
        Gate("checker_file", c("path").rlike(CHECKERS) & ~c("has_flow"), 3, 0.3),
        Gate("no_auth_words", (category == "timing") & ~c("auth_words"), 4, 0.1),
        Gate("safe_load", (category == "model-load") & c("weights_only") & c("ai"), 4, 0.1),
        Gate("static_redirect", (category == "open-redirect") & c("static_redirect"), drop=True),
        Gate("suppressed", c("suppressed"), drop=True),
    ]


def file_facts(lines: DataFrame) -> DataFrame:
    """path and a boolean for each of FILE_WORDS; ``profile``: server if the first 50 lines import a web framework, else library."""
    flags = [F.bool_or(F.col("line").rlike(words)).alias(name) for name, words in FILE_WORDS.items()]
    head = F.bool_or(F.col("line").rlike(FILE_WORDS["web"]) & (F.col("line_no") <= 50))
    return lines.groupBy("path").agg(*flags, F.when(head, "server").otherwise("library").alias("profile"))


def line_facts(lines: DataFrame) -> DataFrame:
    """path, line and a boolean for each of LINE_WORDS."""
    flags = {name: context(lines, "path", F.col("line").rlike(words), k, k) for name, (words, k) in LINE_WORDS.items()}
    return lines.select("path", F.col("line_no").alias("_line"), *(flag.alias(name) for name, flag in flags.items())).withColumnRenamed("_line", "line")


def gated(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings after all gates, each leaving a mark. Findings of files or lines that aren't there have no facts.

    findings: path, line, category, sev_rank, confidence, has_flow, source_kind, tool_param; lines: path, line_no, line.
    """
    facts = [*FILE_WORDS, *LINE_WORDS]
    rows = findings.join(file_facts(lines), "path", "left").join(line_facts(lines), ["path", "line"], "left").na.fill(False, facts)
    for gate in gates():
        if gate.drop:
            rows = rows.filter(~F.coalesce(gate.when, F.lit(False)))
        else:
            rows = demoted(rows, gate.when, gate.rank, gate.confidence, gate.mark)
    return rows.drop(*facts)


def for_profile(findings: DataFrame, profile: str, disabled: dict[str, list[str]]) -> DataFrame:
    """Categories that a deployment profile switches off fall to info, unless a flow or an outside source proves them."""
    off = F.col("category").isin(*disabled.get(profile, [])) & ~F.col("has_flow") & (F.coalesce(F.col("source_kind"), F.lit("")) != "remote")
    return demoted(findings, off & ~F.col("engine").isin("authz", "mfv"), 4, 0.2, "profile_disabled")


def applicable(passes: list[tuple[str, str]], files: DataFrame) -> list[str]:
    """Names of passes whose kind of file is there at all. passes: (name, kind or language or '')."""
    kinds = {r.kind for r in files.select("kind").distinct().collect()}
    langs = {r.lang for r in files.select(F.explode("languages").alias("lang")).distinct().collect()}
    return [name for name, needs in passes if not needs or needs in kinds | langs]
