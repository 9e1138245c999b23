"""Deduplication of findings along lines, occurrence numbers and root-cause clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievekit.operators.materialise import cut


def gap_clusters(rows: DataFrame, keys: list[str], line: str, gap: Column | int, order: list[Column]) -> DataFrame:
    """Gaps and islands: within ``keys``, a row more than ``gap`` after the one before it begins a cluster.

    The first row by ``order`` stays for each cluster, with the cluster's first and last line and its size.
    """
    gap = F.lit(gap) if isinstance(gap, int) else gap
    along = W.partitionBy(*keys).orderBy(line)
    rows = rows.withColumn("_new", F.coalesce((F.col(line) - F.lag(line).over(along) > gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(along.rangeBetween(W.unboundedPreceding, W.currentRow)))
    every = W.partitionBy(*keys, "_island")
    rows = rows.select(
        "*",
        F.row_number().over(every.orderBy(*order)).alias("_rank"),
        F.min(line).over(every).alias("cluster_start"),
        F.max(line).over(every).alias("cluster_end"),
        F.count("*").over(every).alias("occurrence_count"),
    )
    return rows.filter("_rank = 1").drop("_new", "_island", "_rank")


def occurrence_ids(rows: DataFrame, base: str, *order: str) -> DataFrame:
    """``ordinal`` among equal ``base`` values and ``fingerprint``: the base itself first, then a hash of base#n.

    Rows are sorted into ranges, so copies of one value may fill many of them; numbers begin where the ranges before end.
    """
    dealt = rows.repartitionByRange(base, *order).withColumn("_range", F.spark_partition_id())
    dealt = cut(dealt)  # the ranges have to stay as they are
    own = F.row_number().over(W.partitionBy("_range", base).orderBy(*order)) - 1
    counts = dealt.groupBy(base, "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy(base).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    counts = counts.select(base, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = dealt.withColumn("_own", own).join(counts, [base, "_range"]).withColumn("ordinal", F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")
    hashed = F.sha2(F.concat(F.col(base), F.lit("#"), F.col("ordinal").cast("string")), 256)
    return rows.withColumn("fingerprint", F.when(F.col("ordinal") == 0, F.col(base)).otherwise(hashed))


def root_causes(rows: DataFrame, keys: list[str], rank: list[str], member: str) -> DataFrame:
    """One row for each distinct ``keys``: members in order, their number and the first by ``rank``."""
    return rows.groupBy(*keys).agg(
        F.min_by(member, F.struct(*rank)).alias("primary_member"),
        F.count("*").alias("members"),
    )
