"""Scoring of findings against labels, calibration and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.operators.graph import Fronts
from sievekit.operators.joins import containing
from sievekit.operators.materialise import cut, stored


def _ratio(a: Column, b: Column) -> Column:
    return F.round(a / F.nullif(b, F.lit(0)), 6)


def quality_of(rows: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and F2 of boolean ``predicted`` against boolean ``truth``; NULL where nothing can be divided."""
    hit, said, real = F.count_if(F.expr("predicted and truth")), F.count_if("predicted"), F.count_if("truth")
    return rows.groupBy(*by).agg(
        hit.alias("tp"), (said - hit).alias("fp"), (real - hit).alias("fn"),
        _ratio(hit, said).alias("precision"), _ratio(hit, real).alias("recall"), _ratio(5 * hit, 4 * real + said).alias("f2"),
    )


def separation() -> Column:
    """Mean confidence of true findings less that of false ones; 0 if either class is empty. Columns confidence, truth."""
    gap = F.avg(F.when(F.col("truth"), F.col("confidence"))) - F.avg(F.when(~F.col("truth"), F.col("confidence")))
    return F.round(F.coalesce(gap, F.lit(0.0)), 6)


def best_setting(rows: DataFrame, grid: list[tuple[float, float, float]]) -> DataFrame:
    """Of (base, loss, floor) settings the one that separates best, the first of equal ones. rows: hops, truth."""
    settings = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(b).alias("base"), F.lit(d).alias("loss"), F.lit(f).alias("floor")) for k, (b, d, f) in enumerate(grid)))
    counted = rows.groupBy("hops", "truth").count()  # the grid meets sums, not rows
    each = counted.select("*", F.explode(settings).alias("s")).select("*", "s.*")
    each = each.withColumn("confidence", F.round(F.greatest("floor", F.col("base") - F.col("hops") * F.col("loss")), 4))
    mean = lambda flag: F.sum(F.when(F.col("truth") == flag, F.col("confidence") * F.col("count"))) / F.sum(F.when(F.col("truth") == flag, F.col("count")))
    scores = each.groupBy("ord", "base", "loss", "floor").agg(F.round(F.coalesce(mean(True) - mean(False), F.lit(0.0)), 6).alias("separation"))
    best = F.max_by(F.struct("base", "loss", "floor", "separation"), F.struct("separation", -F.col("ord")))
    return scores.agg(best.alias("best")).select("best.*")


def credited(cases: DataFrame, found: DataFrame) -> DataFrame:
    """How a case was met: by the expected rule, else the category, else the CWE; NULL if not at all. Cases: case_id, path, rule_id, category, cwe.

    Three equi-joins with distinct keys, so a path with very many findings isn't paired with its cases.
    """
    ways = [("rule_id", F.col("rule_id")), ("category", F.col("category")), ("cwe", F.explode("cwe"))]
    out = cases.select("case_id").distinct()
    for number, (key, value) in enumerate(ways):
        met = cases.select("case_id", "path", key).join(found.select("path", value.alias(key)).distinct(), ["path", key])
        out = out.join(met.select("case_id", F.lit(("rule", "category", "cwe")[number]).alias(f"_{number}")).distinct(), "case_id", "left")
    return out.select("case_id", F.coalesce("_0", "_1", "_2").alias("credit"))


def pairs_hold(rows: DataFrame) -> DataFrame:
    """Of each vulnerable and fixed pair: found in the one and not in the other. rows: case_id, fixed, hit."""
    return rows.groupBy("case_id").agg((F.count_if(F.expr("hit and not fixed")) > 0).alias("detected"), (F.count_if(F.expr("hit and fixed")) == 0).alias("clean_after_fix"))


def drift(counts: DataFrame, baseline: DataFrame, total: int = 5, urgent: int = 0) -> DataFrame:
    """Repositories whose counts exceed the baseline's by more than is tolerated. Columns: repo, total, urgent."""
    b = baseline.select("repo", F.col("total").alias("_total"), F.col("urgent").alias("_urgent"))
    rows = counts.join(b, "repo", "left").na.fill(0, ["_total", "_urgent"])
    return rows.withColumn("failed", (F.col("total") - F.col("_total") > total) | (F.col("urgent") - F.col("_urgent") > urgent)).drop("_total", "_urgent")


def unreviewed(found: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Urgent findings that nobody has judged."""
    return found.filter("sev_rank <= 1").join(reviewed.select("fingerprint").distinct(), "fingerprint", "left_anti")


def one_to_one(candidates: DataFrame) -> DataFrame:
    """``finding`` and ``sink`` of a matching in which each has one partner at most, as taking the best pairs one after the other gives it.

    candidates: finding, sink, rank, distance; less is better, then the smaller sink, then the smaller finding. In each round
    findings and sinks that are each other's best pair leave, so the rounds are as many as the longest chain of pairs that wait for
    another; only the least is kept of each finding and sink before a shuffle.
    """
    order = F.struct("rank", "distance", "sink", "finding")
    left = cut(candidates.groupBy("finding", "sink").agg(F.min(F.struct("rank", "distance")).alias("_b")).select("finding", "sink", "_b.rank", "_b.distance"))
    taken: Fronts | None = None
    while True:
        of_finding = left.groupBy("finding").agg(F.min_by("sink", order).alias("sink"))
        of_sink = left.groupBy("sink").agg(F.min_by("finding", order).alias("finding"))
        pairs = cut(of_finding.join(of_sink, ["finding", "sink"]).select("finding", "sink"))
        if taken is None:
            taken = Fronts(pairs)
        else:
            taken.add(pairs)
        if pairs.isEmpty():
            return taken.all()
        left = cut(left.join(pairs.select("finding"), "finding", "left_anti").join(pairs.select("sink"), "sink", "left_anti"))


#: Lines to either side of a labelled sink in which a finding may count for it.
SINK_WINDOW = 15


def distinct_findings(findings: DataFrame, expected: DataFrame, decoys: DataFrame, reach: int = SINK_WINDOW) -> DataFrame:
    """Each finding with its ``state`` and ``sink``: decoy, hit, duplicate, mismatch, or unmatched.

    findings: finding, path, line, cwe (array), rule_id; expected: sink, path, line_hint, cwe, native_rule; decoys: path,
    first, last, cwe. A finding with the CWE of a decoy within its lines is its alarm and nothing else. Others are
    candidates for the sinks near them that name their rule (rank 0) or their CWE (1); each sink has one hit, and a candidate without
    a sink of its own is a duplicate of its best one. A finding that is near sinks but has other CWEs than all of them is a mismatch of
    the nearest.
    """
    size = reach + 1
    # Findings are made once; what is told of them goes by numbers, which are shorter than their names.
    rows = stored(findings.withColumn("_n", F.monotonically_increasing_id()))
    alarms = stored(_within(rows.select("_n", "path", "line", F.explode("cwe").alias("cwe")), decoys))
    left = rows.select("_n", "finding", "path", "line", "cwe", "rule_id").withColumn("_block", F.floor(F.col("line") / size))
    right = expected.select("sink", "path", "line_hint", F.col("cwe").alias("_cwe"), "native_rule")
    right = right.withColumn("_block", F.explode(F.sequence(F.floor((F.col("line_hint") - reach) / size), F.floor((F.col("line_hint") + reach) / size))))
    near = left.join(right, ["path", "_block"]).withColumn("distance", F.abs(F.col("line") - F.col("line_hint"))).filter(F.col("distance") <= reach)
    rank = F.when(F.col("native_rule") == F.col("rule_id"), 0).when(F.array_contains("cwe", F.col("_cwe")), 1)
    near = near.select("_n", "finding", "sink", "distance", rank.alias("rank"), (F.size("cwe") > 0).alias("_told"))
    near = stored(near.join(alarms, "_n", "left_anti").filter("rank is not null or _told"))
    hits = one_to_one(near.filter("rank is not null").select("finding", "sink", "rank", "distance")).select("finding", F.col("sink").alias("_hit"))
    best, nearest = F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "distance", "sink"))), F.min(F.struct("distance", "sink"))
    # Dealt by name once: the sums and the hits meet there.
    told = near.repartition("finding").groupBy("_n", "finding").agg(best.alias("_b"), nearest.alias("_d"), F.bool_or("_told").alias("_told")).join(hits, "finding", "left")
    told = told.select("_n", "_hit", F.col("_b.sink").alias("_best"), F.when(F.col("_told"), F.col("_d.sink")).alias("_near"))
    rows = rows.join(alarms.withColumn("_alarm", F.lit(True)), "_n", "left").join(told, "_n", "left")
    state = F.when(F.col("_alarm"), "decoy").when(F.col("_hit").isNotNull(), "hit").when(F.col("_best").isNotNull(), "duplicate").when(F.col("_near").isNotNull(), "mismatch").otherwise("unmatched")
    return rows.select(*findings.columns, state.alias("state"), F.coalesce("_hit", "_best", "_near").alias("sink"))


def _within(alarms: DataFrame, decoys: DataFrame) -> DataFrame:
    """The findings (``_n``) that lie in a decoy of their path and CWE."""
    key = F.concat_ws("#", "cwe", "path")
    held = containing(alarms.select("_n", "line", key.alias("_key")), decoys.withColumn("_key", key).select("_key", "first", "last"), "_key", "line", "first", "last", [])
    return held.select("_n").distinct()


def rule_scores(scored: DataFrame) -> DataFrame:
    """Findings, hits, duplicates, alarms at decoys, mismatches and the rest by rule; the last five add up to the first."""
    n = lambda s: F.count_if(F.col("state") == s)
    return scored.groupBy("rule_id").agg(
        F.count("*").alias("findings"), n("hit").alias("distinct_tp"), n("duplicate").alias("duplicates"), n("decoy").alias("decoy_fp"), n("mismatch").alias("mismatches"), n("unmatched").alias("unmatched")
    )
