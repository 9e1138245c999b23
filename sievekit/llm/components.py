"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node in ``edges`` (long ``a`` and ``b``).

    Each round replaces edges by edges to the smallest neighbour; minima are summed up map-side first, and the
    joins are between written tables, so that a node with very many edges is split between tasks (a checkpoint
    would keep the filters' constraints, which multiply from round to round in the optimiser). Edges of a node
    to itself are ignored. Raises RuntimeError if ``rounds`` don't suffice (log of the longest path).
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    state = _state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(large.filter("a != b"))
        least = written(edges.groupBy("a").agg(F.min("b").alias("m")))
        small = edges.join(least, "a")
        small = small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = written(small.filter("a != b").distinct())
        before, state = state, _state(edges)
        if state == before:
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError("components: more rounds are needed")
