"""Lines of texts, rules over lines, and windows of lines."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievekit.functions.text import LINE_BREAK, entropy, is_placeholder, net_depth

SUPPRESSION = r"#\s*nosec\b|//\s*nosec\b|nosemgrep"


def lines_of(texts: DataFrame, id_col: str, text_col: str, *keep: str, most: int | None = None) -> DataFrame:
    """One row a line: id, ``line_no`` from 1, ``line``: the whole of it, or its first ``most`` characters (rules see LINE_CHARS)."""
    rows = texts.select(id_col, *keep, F.posexplode(F.split(text_col, LINE_BREAK, -1)).alias("_pos", "_line"))
    return rows.select(id_col, *keep, (F.col("_pos") + 1).cast("long").alias("line_no"), (F.substring("_line", 1, most) if most else F.col("_line")).alias("line"))


def _either(line: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (line.rlike(p) for p in patterns)) if patterns else F.lit(False)


def excluded(path: Column, globs: list[str]) -> Column:
    """Does a glob match the whole path, or does one without wildcards stand in it?"""
    plain = [g for g in globs if not any(c in g for c in "*?[")]
    wild = [fnmatch.translate(g).replace("\\Z", "$").replace("\\z", "$") for g in globs if g not in plain]
    return reduce(lambda a, b: a | b, [*(path.contains(g) for g in plain), *(path.rlike("^" + w) for w in wild)], F.lit(False))


def rule_hits(lines: DataFrame, rules: list[dict], line_col: str = "line", language_col: str | None = None, path_col: str | None = None) -> DataFrame:
    """Lines with each rule that finds something in them.

    A rule is {rule_id, patterns, not, languages, every, secret, exclude_paths}: any of ``patterns`` finds something and none of
    ``not`` does; suppressed lines are out. ``every`` gives a row for each pattern that matches. ``secret`` drops
    values that look like stand-ins or have under 3 bits a character. The rules are plain expressions on one scan:
    no join, and a line that no rule matches leaves the scan at once.
    """
    line = F.col(line_col)
    hits = []
    for rule in rules:
        ok = ~_either(line, rule.get("not", []))
        if language_col and rule.get("languages"):
            ok = ok & F.col(language_col).isin(*rule["languages"])
        if path_col and rule.get("exclude_paths"):
            ok = ok & ~excluded(F.col(path_col), rule["exclude_paths"])
        groups = [[p] for p in rule["patterns"]] if rule.get("every") else [rule["patterns"]]
        for number, patterns in enumerate(groups):
            match = F.regexp_extract(line, "|".join(f"(?:{p})" for p in patterns), 0)
            good = ok & _either(line, patterns)
            if rule.get("secret"):
                good = good & ~is_placeholder(match) & (entropy(match) >= 3.0) & ~line.rlike(r"os\.environ|getenv|process\.env")
            hits.append(F.when(good, F.struct(F.lit(rule["rule_id"]).alias("rule_id"), F.lit(number).alias("pattern_no"), match.alias("match"))))
    found = lines.filter(~line.rlike(SUPPRESSION)).withColumn("_hit", F.explode(F.array_compact(F.array(*hits))))
    return found.select(*lines.columns, "_hit.*")


def context(lines: DataFrame, id_col: str, flag: Column, before: int, after: int) -> Column:
    """Is ``flag`` true on any line from ``before`` lines back to ``after`` lines on?"""
    w = W.partitionBy(id_col).orderBy("line_no").rowsBetween(-before, after)
    return F.coalesce(F.max(flag).over(w), F.lit(False))


def statements(lines: DataFrame, id_col: str) -> DataFrame:
    """``stmt_id``: lines joined while brackets are open. The depth never falls below 0.

    With S the running sum of net depths, the clamped depth is S - min(0, running minimum of S).
    """
    w = W.partitionBy(id_col).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = lines.withColumn("_s", F.sum(net_depth(F.col("line"))).over(w))
    rows = rows.withColumn("depth", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w)))
    closed = F.when(F.col("depth") == 0, 1).otherwise(0)
    before = W.partitionBy(id_col).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("stmt_id", F.coalesce(F.sum(closed).over(before), F.lit(0))).drop("_s")
