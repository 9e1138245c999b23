"""Scores, gates, views and merges of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values. Ranks: 0 critical to 4 info.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
SEVERITY_ALIASES = {"error": "high", "warning": "medium", "warn": "medium"}
#: Confidence: base, loss for each hop, floor.
MODELS = {"cross-file": (0.75, 0.10, 0.25), "taint": (0.90, 0.08, 0.65)}
PATTERN_CAP = 0.70
VIEW_CATEGORIES = ["injection", "deserialization", "ssti", "xss", "command-injection", "path-traversal", "nosql-injection", "prototype-pollution"]
SELF_EVIDENT = ["secrets", "crypto"]
COMPUTED_TIERS = ["taint-flow", "engine"]
AUDIT_ONLY_CWES = [117]


def severity_rank(severity: Column) -> Column:
    """Rank of a severity name or alias; 5 if unknown."""
    name = F.lower(severity)
    known = {s: k for k, s in enumerate(SEVERITIES)}
    known |= {alias: known[s] for alias, s in SEVERITY_ALIASES.items()}
    out = F.create_map(*(x for k, v in known.items() for x in (F.lit(k), F.lit(v))))[name]
    return F.coalesce(out, F.lit(5))


def hop_confidence(hops: Column, model: str) -> Column:
    base, loss, floor = MODELS[model]
    return F.round(F.greatest(F.lit(floor), F.lit(base) - hops * F.lit(loss)), 4)


def evidence_tier() -> Column:
    """From columns has_flow, engine, category: what the finding rests on."""
    return (
        F.when(F.col("has_flow"), "taint-flow")
        .when(F.col("engine").isin("taint", "crossfile", "sca"), "engine")
        .when(F.col("category").isin(*SELF_EVIDENT), "self-evident")
        .otherwise("pattern-only")
    )


def in_view(strict: bool) -> Column:
    """The actionable view, or with ``strict`` the confirmed one: an ordered list of rules, the first that applies decides.

    Columns: cwe (array), tier, unconfirmed, engine, sev_rank, reachability, inventory_rule, dangerous_rule, category.
    """
    cwe, tier, rank = F.col("cwe"), F.col("tier"), F.col("sev_rank")
    audit_only = (F.size(cwe) > 0) & F.forall(cwe, lambda x: x.isin(*AUDIT_ONLY_CWES))
    proven = F.coalesce(tier.isin(*COMPUTED_TIERS), F.lit(False))
    out = F.when(F.coalesce(audit_only, F.lit(False)), False)
    if strict:
        out = out.when(~(proven | F.coalesce(tier == "self-evident", F.lit(False))) | F.coalesce(F.col("unconfirmed"), F.lit(False)), False)
    out = out.when((F.col("engine") == "authz") & (tier == "authorization-gap"), rank <= 2).when(rank <= 1, True).when(rank >= 3, False)
    out = out.when(proven, True).when(F.col("reachability") == "reachable", True).when(F.col("inventory_rule"), False)
    out = out.when(F.col("category").isin(*SELF_EVIDENT) | F.col("dangerous_rule"), True)
    return out.otherwise(F.lit(False) if strict else F.coalesce(F.col("category").isin(*VIEW_CATEGORIES), F.lit(False)))


def with_thresholds(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Disabled rules and findings of too little confidence go; severities are capped unless a flow is proven.

    thresholds: rule_id, enabled, min_confidence, max_rank (a rank, so a cap is a least value); rules without a row pass.
    """
    joined = rows.join(thresholds, "rule_id", "left")
    kept = joined.filter(F.coalesce("enabled", F.lit(True)) & (F.coalesce("min_confidence", F.lit(0.0)) <= F.col("confidence")))
    cap = F.when(F.col("max_rank").isNotNull() & ~F.col("has_flow"), F.greatest("sev_rank", "max_rank")).otherwise(F.col("sev_rank"))
    return kept.withColumn("sev_rank", cap).drop("enabled", "min_confidence", "max_rank")


def demoted(rows: DataFrame, when: Column, rank: int, confidence: float, mark: str) -> DataFrame:
    """Where ``when`` holds, severity falls to ``rank`` and confidence to ``confidence`` at most; neither ever rises."""
    hit = F.coalesce(when, F.lit(False))
    return rows.withColumns(
        {
            "sev_rank": F.when(hit, F.greatest("sev_rank", F.lit(rank))).otherwise(F.col("sev_rank")),
            "confidence": F.when(hit, F.least("confidence", F.lit(confidence))).otherwise(F.col("confidence")),
            mark: hit,
        }
    )


def without_ignored(rows: DataFrame, entries: DataFrame, today: Column) -> DataFrame:
    """Findings less those that a valid entry names: by fingerprint, or by rule and a pattern of the path (NULL: any).

    entries: fingerprint, rule_id, path_regex, expires (ISO date or NULL).
    """
    valid = entries.filter(F.col("expires").isNull() | (F.col("expires") >= F.date_format(today, "yyyy-MM-dd")))
    by_print = valid.filter("fingerprint is not null").select("fingerprint").distinct()
    by_rule = valid.filter("fingerprint is null").select("rule_id", "path_regex").distinct()
    left = rows.join(by_print, "fingerprint", "left_anti")
    hit = (left["rule_id"] == by_rule["rule_id"]) & (by_rule["path_regex"].isNull() | F.expr("path rlike path_regex"))
    return left.join(by_rule, hit, "left_anti")


def new_since(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint isn't in the baseline."""
    return rows.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def merged_rule_groups(rows: DataFrame, groups: dict[str, str], gap: int = 2) -> DataFrame:
    """Rules of one group that report lines at most ``gap`` apart are one finding: the severest, then the smallest rule id.

    Adds ``duplicate_rule_ids``, sorted, without the survivor's own.
    """
    name = F.create_map(*(x for k, v in groups.items() for x in (F.lit(k), F.lit(v))))[F.col("rule_id")]
    rows = rows.withColumn("_group", F.coalesce(name, F.concat(F.lit("rule:"), F.col("rule_id"))))
    along = W.partitionBy("path", "_group").orderBy("line")
    rows = rows.withColumn("_new", F.coalesce((F.col("line") - F.lag("line").over(along) > gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(along.rangeBetween(W.unboundedPreceding, W.currentRow)))
    grouped = rows.groupBy("path", "_group", "_island").agg(
        F.min_by(F.struct("rule_id", "line", "sev_rank"), F.struct("sev_rank", "rule_id", "line")).alias("_first"), F.collect_set("rule_id").alias("_ids")
    )
    out = grouped.select("path", "_first.*", "_ids")
    return out.withColumn("duplicate_rule_ids", F.array_sort(F.array_remove("_ids", F.col("rule_id")))).drop("_ids")


def merge_same_sink(rows: DataFrame) -> DataFrame:
    """Findings of one line that name the same issue become one.

    Order: proven flow, then severity, then rule. Each row joins the first survivor of another rule with a shared
    CWE; the survivor takes over its CWEs, so the order matters and a line's findings are folded one after the
    other. A group is one line of one file. Columns: path, line, rule_id, sev_rank, has_flow, cwe; adds ``absorbed``.
    """
    one = F.struct((~F.col("has_flow")).alias("no_flow"), "sev_rank", "rule_id", "cwe")
    grouped = rows.groupBy("path", "line").agg(F.array_sort(F.collect_list(one)).alias("_rows"))
    none = F.array().cast("array<string>")

    def survivor(o: Column, cwe: Column, absorbed: Column) -> Column:
        return F.struct(o["no_flow"].alias("no_flow"), o["sev_rank"].alias("sev_rank"), o["rule_id"].alias("rule_id"), cwe.alias("cwe"), absorbed.alias("absorbed"))

    def step(kept: Column, x: Column) -> Column:
        same = F.transform(kept, lambda o: (o["rule_id"] != x["rule_id"]) & F.coalesce(F.arrays_overlap(o["cwe"], x["cwe"]), F.lit(False)))
        at = F.array_position(same, F.lit(True))

        def take(o: Column, k: Column) -> Column:
            joined = survivor(o, F.array_sort(F.array_union(o["cwe"], x["cwe"])), F.array_sort(F.array_union(o["absorbed"], F.array(x["rule_id"]))))
            return F.when(k + 1 == at, joined).otherwise(survivor(o, o["cwe"], o["absorbed"]))

        return F.when(at > 0, F.transform(kept, take)).otherwise(F.concat(kept, F.array(survivor(x, x["cwe"], none))))

    kind = rows.schema["cwe"].dataType.simpleString()
    rank, rule = rows.schema["sev_rank"].dataType.simpleString(), rows.schema["rule_id"].dataType.simpleString()
    start = F.array().cast(f"array<struct<no_flow:boolean,sev_rank:{rank},rule_id:{rule},cwe:{kind},absorbed:array<string>>>")
    out = grouped.select("path", "line", F.explode(F.aggregate("_rows", start, step)).alias("_s"))
    return out.select("path", "line", "_s.rule_id", "_s.sev_rank", (~F.col("_s.no_flow")).alias("has_flow"), "_s.cwe", "_s.absorbed")
