"""Evidence that a sink is guarded: checks near it that name what it uses, and early exits that stand before it on every way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.functions.text import identifiers
from sievekit.operators.joins import containing, latest_before
from sievekit.operators.lines import statements
from sievekit.operators.selection import first_after

#: Lines to either side in which a check counts, and lines before a sink for languages without statement trees.
SANITIZER_REACH, GUARD_REACH = 10, 40


def near_evidence(sinks: DataFrame, lines: DataFrame, kinds: Column, shapes: Column, before: int, after: int, stop: list[str]) -> DataFrame:
    """``finding`` and ``evidence`` (its kinds, sorted) of each sink with evidence near it.

    sinks: finding, path, line; lines: path, line_no, line. ``kinds``: of a line, the names of the checks that it shows. A
    check counts on the sink's own line; up to ``before`` lines ahead of it and ``after`` behind where both lines share an
    identifier that isn't a ``stop`` word; and, for the names in ``shapes`` (an array), on any line of the sink's statement. Lines
    meet by path, identifier and block of lines, so no two lines without a shared identifier are paired.
    """
    size = before + after + 1
    rows = statements(lines.select("path", "line_no", "line"), "path").select("path", "line_no", "stmt_id", identifiers(F.col("line"), stop).alias("_words"), kinds.alias("_kinds"))
    asked = sinks.select("finding", "path", F.col("line").alias("line_no")).join(rows, ["path", "line_no"])
    checks = rows.filter(F.size("_kinds") > 0)
    own = asked.select("finding", F.explode("_kinds").alias("kind"))
    words = asked.select("finding", "path", F.col("line_no").alias("_at"), F.explode("_words").alias("_word"))
    words = words.withColumn("_block", F.explode(F.sequence(F.floor((F.col("_at") - before) / size), F.floor((F.col("_at") + after) / size))))
    index = checks.select("path", "line_no", "_kinds", F.explode("_words").alias("_word")).withColumn("_block", F.floor(F.col("line_no") / size))
    near = words.join(index, ["path", "_word", "_block"]).filter(F.col("line_no").between(F.col("_at") - before, F.col("_at") + after))
    near = near.select("finding", "_kinds").distinct().select("finding", F.explode("_kinds").alias("kind"))
    formed = checks.select("path", "stmt_id", F.explode(F.array_intersect("_kinds", shapes)).alias("kind")).distinct()
    formed = asked.select("finding", "path", "stmt_id").join(formed, ["path", "stmt_id"]).select("finding", "kind")
    return own.unionByName(near).unionByName(formed).groupBy("finding").agg(F.array_sort(F.collect_set("kind")).alias("evidence"))


def dominating_guards(sinks: DataFrame, blocks: DataFrame, guards: DataFrame, assignments: DataFrame) -> DataFrame:
    """``finding``, ``guard_line`` and ``kind`` of the first early exit that protects each sink's variable; sinks without one are left out.

    sinks: finding, path, scope, line, var; blocks: path, block, begin, end, the lines of statement lists (bodies and other
    branches, the function's own too); guards: path, block (the list they stand in), var, line, kind, tests of ``var`` whose
    body always leaves; assignments: path, scope, var, line. What stands earlier in a list that leads to the sink is passed on every
    way to it, so a guard counts if its list holds the sink, it stands before it, and the variable isn't assigned in
    between. Sinks meet their lists by intervals, and guards by one sort for each list and variable.
    """
    key = ["path", "block", "var"]
    given = assignments.select("path", "scope", "var", "line", F.col("line").alias("_since"))
    asked = latest_before(sinks.select("finding", "path", "scope", "var", "line").withColumn("line", F.col("line") - 1), given, ["path", "scope", "var"], "line", "_since")
    asked = asked.withColumn("line", F.col("line") + 1).withColumn("_since", F.coalesce("_since", F.lit(0).cast(given.schema["_since"].dataType)))
    held = containing(asked, blocks, "path", "line", "begin", "end", ["block"])
    marks = held.select(*key, F.col("_since").alias("line")).distinct()
    first = first_after(marks, guards, key).select(*key, F.col("line").alias("_since"), F.col("first_use").alias("guard_line")).dropna()
    found = held.join(first, [*key, "_since"]).filter("guard_line < line")
    named = guards.groupBy(*key, F.col("line").alias("guard_line")).agg(F.min("kind").alias("kind"))
    return found.join(named, [*key, "guard_line"]).groupBy("finding").agg(F.min(F.struct("guard_line", "kind")).alias("_g")).select("finding", "_g.*")


def demoted_by_guards(findings: DataFrame, guarded: DataFrame, most: float = 0.3) -> DataFrame:
    """Flow findings behind a guard keep ``most`` confidence at most and say of what kind it is. findings: finding, confidence, has_flow."""
    rows = findings.join(guarded.select("finding", F.col("kind").alias("guard_kind")), "finding", "left")
    kind = F.when(F.col("has_flow"), F.col("guard_kind"))
    lowered = F.when(kind.isNotNull(), F.least("confidence", F.lit(most))).otherwise(F.col("confidence"))
    return rows.withColumns({"guard_kind": kind, "confidence": lowered})
