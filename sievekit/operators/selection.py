"""Which findings are looked at first, which stand for others, and what each step has kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievekit.operators.materialise import cut


def at_least_severe(rows: DataFrame, rank: int) -> DataFrame:
    """Findings of severity ``rank`` or worse."""
    return rows.filter(F.col("sev_rank") <= rank)


def priority(rows: DataFrame, order: list[str], most: int = 150) -> DataFrame:
    """What is worth a close look: severe, with a whole flow, across files, or reachable; AI findings but for plain notes.

    Dependency findings have no code to look at. If nothing is severe enough, the first ``most`` medium ones of
    confidence 0.6 or more, in ``order``, take its place (this limit is the feature). Columns: engine, sev_rank, has_flow,
    reachability, confidence, is_ai.
    """
    code = rows.filter("engine != 'depguard'")
    urgent = (F.col("sev_rank") <= 1) | F.col("has_flow") | (F.col("engine") == "crossfile") | F.coalesce(F.col("reachability") == "reachable", F.lit(False))
    ai = F.col("is_ai") & (F.col("sev_rank") != 4)
    if not code.filter(urgent).isEmpty():
        return code.filter(urgent | ai)
    medium = (F.col("sev_rank") == 2) & (F.col("confidence") >= 0.6)
    # All columns follow the order, so the first ones are the same whenever they are taken; equal rows are counted.
    every = [c for c in code.columns if c not in order]
    first = cut(code.filter(medium).orderBy(*order, *every).limit(most))
    return first.unionByName(code.filter(ai).exceptAll(first.filter(ai)))


def kill_chains(rows: DataFrame, templates: dict[str, list[str]], text: str, source: str) -> DataFrame:
    """Templates of which at least two tokens stand in the findings' texts: chain, tokens, contributors (distinct sources), first_source."""
    known = F.array(*(F.struct(F.lit(name).alias("chain"), F.lit(token).alias("token")) for name, tokens in templates.items() for token in tokens))
    present = F.filter(known, lambda x: F.contains(F.lower(text), F.lower(x["token"])))
    met = rows.select(F.col(source).alias("source"), F.explode(present).alias("x")).select("source", "x.*")
    each = met.groupBy("chain").agg(F.count_distinct("token").alias("tokens"), F.count_distinct("source").alias("contributors"), F.min("source").alias("first_source"))
    return each.filter("tokens >= 2")


def without_absorbed(rows: DataFrame, flows: DataFrame) -> DataFrame:
    """Findings less those without a flow that stand on a line through which another rule's flow passes and share a CWE with it.

    flows: path, line, rule_id, cwe, trace (array of lines of the same file), unconfirmed. The flow's own line isn't part of its trace.
    """
    passed = flows.filter("not unconfirmed").select("path", F.col("rule_id").alias("_rule"), F.col("cwe").alias("_cwe"), F.explode(F.array_remove("trace", F.col("line"))).alias("line")).distinct()
    cond = (rows["path"] == passed["path"]) & (rows["line"] == passed["line"]) & (rows["rule_id"] != passed["_rule"]) & F.arrays_overlap(rows["cwe"], passed["_cwe"]) & ~rows["has_flow"]
    return rows.join(passed, cond, "left_anti")


def first_of_each(rows: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key: examples for a report."""
    n = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def stage_counts(rows: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """stage, kept: how many rows are left after each of the filters, one after the other, in one pass over the rows."""
    kept, counts = F.lit(True), [F.count("*").alias("s0")]
    for number, (_, condition) in enumerate(stages, 1):
        kept = kept & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(kept).alias(f"s{number}"))
    names = ["all", *(name for name, _ in stages)]
    pairs = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(name).alias("stage"), F.col(f"s{k}").alias("kept")) for k, name in enumerate(names)))
    return rows.agg(*counts).select(F.explode(pairs).alias("x")).select("x.*")


def in_plan_order(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Results of several passes with ``pass_no``, their place in the plan, whatever the order in which they ended."""
    return reduce(DataFrame.unionByName, (df.withColumns({"pass_no": F.lit(k), "pass_name": F.lit(name)}) for k, (name, df) in enumerate(parts)))


def all_found(expected: DataFrame, found: DataFrame) -> DataFrame:
    """case_id, met: is every expected (path, line, rule_id) of a case among the findings?"""
    hits = found.select("path", "line", "rule_id").distinct().withColumn("_hit", F.lit(True))
    return expected.join(hits, ["path", "line", "rule_id"], "left").groupBy("case_id").agg(F.bool_and(F.coalesce("_hit", F.lit(False))).alias("met"))


def first_after(marks: DataFrame, uses: DataFrame, key: list[str]) -> DataFrame:
    """Each mark (key, line) with ``first_use``, the least line of a use of its key behind it; NULL if there is none.

    One sort of both by key, backwards: no pair of a mark and a use is made.
    """
    both = marks.select(*key, "line", F.lit(True).alias("_mark")).unionByName(uses.select(*key, "line", F.lit(False).alias("_mark")))
    later = W.partitionBy(*key).orderBy("line").rangeBetween(1, W.unboundedFollowing)
    seen = F.min(F.when(~F.col("_mark"), F.col("line"))).over(later)
    return both.withColumn("first_use", seen).filter("_mark").drop("_mark").distinct()
