"""Packages: inventory, names that imitate others, undeclared imports, chains, lock files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.functions.text import one_edit_apart, package_name
from sievekit.operators.graph import layers, paths


def inventory(packages: DataFrame) -> DataFrame:
    """One row a component: ecosystem, name, version, its files in order, the shortest chain (of equal ones the smallest)."""
    return packages.groupBy("ecosystem", "name", "version").agg(
        F.array_sort(F.collect_set("file")).alias("files"),
        F.min_by("chain", F.struct(F.size("chain"), F.col("chain"))).alias("chain"),
        F.bool_or("direct").alias("direct"),
    )


def without_shadowed(manifests: DataFrame, locks: dict[str, list[str]]) -> DataFrame:
    """Manifests less those that have a lock file with content beside them. Columns: dir, name, size."""
    pairs = [(m, lock) for m, found in locks.items() for lock in found]
    known = manifests.sparkSession.createDataFrame(pairs, "name string, lock string")
    present = manifests.filter("size > 0").select("dir", F.col("name").alias("lock"))
    shadowed = present.join(F.broadcast(known), "lock").select("dir", "name")  # a few pairs of names
    return manifests.join(shadowed, ["dir", "name"], "left_anti")


def _shortened(name: Column) -> Column:
    """The name and every name that lacks one of its characters."""
    cuts = F.transform(F.sequence(F.lit(1), F.char_length(name)), lambda k: F.concat(name.substr(F.lit(1), k - 1), name.substr(k + 1, F.char_length(name))))
    return F.array_distinct(F.concat(F.array(name), cuts))


def imitations(names: DataFrame, popular: DataFrame, name: str = "name", least_chars: int = 4) -> DataFrame:
    """Names one edit away from a popular one (insertion, deletion, substitution, swap), with the smallest such.

    Two names that are one edit apart share a name that lacks one character at most, so an equi-join on these
    finds all pairs; the exact test follows.
    """
    left = names.select(name).distinct().filter(F.char_length(name) >= least_chars).join(popular.select(F.col(name)), name, "left_anti")
    left = left.select(name, F.explode(_shortened(F.col(name))).alias("_key"))
    right = popular.select(F.col(name).alias("popular")).distinct()
    right = right.select("popular", F.explode(_shortened(F.col("popular"))).alias("_key"))
    pairs = left.join(right, "_key").select(name, "popular").distinct().filter(one_edit_apart(F.col(name), F.col("popular")))
    return pairs.groupBy(name).agg(F.min("popular").alias("popular"))


def undeclared(imports: DataFrame, declared: DataFrame, standard: list[str], local: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """Imports that nothing declares: neither the standard library, nor the project, nor a declared package under either of its names.

    ``known`` maps import names to distribution names. imports: module; declared: name; local: module.
    """
    rows = imports.select("module").distinct().filter(~F.col("module").isin(*standard)).join(local.select("module").distinct(), "module", "left_anti")
    other = F.create_map(*(F.lit(x) for pair in (known or {"": ""}).items() for x in pair))[F.col("module")]
    rows = rows.withColumn("package", package_name(F.coalesce(other, F.col("module")))).withColumn("_own", package_name(F.col("module")))
    names = declared.select(package_name(F.col("name")).alias("package")).distinct()
    return rows.join(names, "package", "left_anti").join(names.withColumnRenamed("package", "_own"), "_own", "left_anti").select("module", "package")


def chains(edges: DataFrame, direct: DataFrame) -> DataFrame:
    """The shortest chain from a direct dependency to each package, the direct one first. edges: caller needs callee."""
    reached = layers(edges, direct, upward=False)
    return paths(reached).select("node", F.reverse("path").alias("chain"))


def reachable_symbol(advisories: DataFrame, calls: DataFrame) -> DataFrame:
    """Advisories with the smallest call that reaches their function: a dotted one exactly, a bare one within the package.

    advisories: advisory_id, package, symbol; calls: symbol of resolved calls.
    """
    own = calls.select(F.col("symbol").alias("call"), F.element_at(F.split("symbol", r"\."), 1).alias("package"), F.element_at(F.split("symbol", r"\."), -1).alias("_tail")).distinct()
    dotted = advisories.filter(F.col("symbol").contains(".")).join(own.select("call"), F.col("symbol") == F.col("call"))
    bare = advisories.filter(~F.col("symbol").contains(".")).join(own, "package").filter("_tail = symbol")
    hits = dotted.select("advisory_id", "call").unionByName(bare.select("advisory_id", "call")).groupBy("advisory_id").agg(F.min("call").alias("evidence"))
    return advisories.join(hits, "advisory_id", "left").withColumn("reachability", F.when(F.col("evidence").isNotNull(), "reachable").otherwise("unknown"))
