"""Rules, thresholds, ignore entries and baselines from small files, as rows."""

from __future__ import annotations

import json
import re

import yaml
from pyspark.sql import DataFrame, SparkSession

from sievekit.operators.findings import SEVERITIES, SEVERITY_ALIASES


def parse_rules(text: str) -> list[dict]:
    """Rules of a YAML text in the form that operators.lines.rule_hits takes.

    Taint rules and rules without a pattern are left out, patterns that don't compile are dropped, severities and
    their aliases become ranks, a missing category is 'general'.
    """
    out = []
    for raw in (yaml.safe_load(text) or {}).get("rules", []):
        if raw.get("mode") == "taint" or "id" not in raw:
            continue
        severity = str(raw.get("severity", "info")).lower()
        severity = SEVERITY_ALIASES.get(severity, severity)
        rule = {
            "rule_id": raw["id"], "rank": SEVERITIES.index(severity) if severity in SEVERITIES else 5, "category": raw.get("category", "general"),
            "cwe": [int(m) for c in raw.get("cwe", []) for m in re.findall(r"\d+", str(c))[:1]], "languages": raw.get("languages", []),
            "patterns": _compiled(raw.get("patterns")), "not": _compiled(raw.get("pattern-not")), "every": "SECRET" in raw["id"], "secret": raw.get("category") == "secrets",
            "message": raw.get("message", ""),
        }
        if rule["patterns"]:
            out.append(rule)
    return out


def _compiled(patterns: object) -> list[str]:
    if not isinstance(patterns, list):
        return []
    out = []
    for pattern in patterns:
        if isinstance(pattern, str):
            try:
                re.compile(pattern)
            except re.error:
                continue
            out.append(re.sub(r"^\{", r"\\{", pattern))
    return out


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    rows = [(r["rule_id"], r["rank"], r["category"], r["cwe"], r["languages"], r["message"]) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, sev_rank int, category string, cwe array<int>, languages array<string>, message string")


def thresholds_table(spark: SparkSession, text: str) -> DataFrame:
    rows = []
    for rule, raw in ((yaml.safe_load(text) or {}).get("rules") or {}).items():
        cap = str(raw["max_severity"]).lower() if raw.get("max_severity") else None
        least = raw.get("min_confidence")
        rows.append((rule, bool(raw.get("enabled", True)), None if least is None else float(least), SEVERITIES.index(cap) if cap in SEVERITIES else None))
    return spark.createDataFrame(rows, "rule_id string, enabled boolean, min_confidence double, max_rank int")


def ignore_table(spark: SparkSession, text: str) -> DataFrame:
    """Entries with a fingerprint, or a rule and maybe a path; paths are patterns or folders."""
    from sievekit.sources.files import glob_regex

    rows = []
    for raw in (yaml.safe_load(text) or {}).get("ignore") or []:
        path = raw.get("path")
        rows.append((raw.get("fingerprint"), raw.get("rule_id"), glob_regex("/" + path.lstrip("/")) if path else None, str(raw["expires"]) if raw.get("expires") else None))
    return spark.createDataFrame(rows, "fingerprint string, rule_id string, path_regex string, expires string")


def baseline_table(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(f,) for f in sorted(set(json.loads(text)["fingerprints"]))], "fingerprint string")
