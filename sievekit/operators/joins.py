"""Joins that findings need beyond equality: innermost scopes, nearest assignments, channels, bindings, windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievekit.operators.materialise import cut


def containing(points: DataFrame, scopes: DataFrame, key: str, at: str, begin: str, end: str, carry: list[str]) -> DataFrame:
    """Each point with every scope of its key that holds it. Places are whole numbers.

    Scopes stand in blocks of a power of two that is at least their length, so in two at most. One sort of scopes and points by
    block of the largest size tells of which sizes a scope that has begun before a point hasn't ended: only in its blocks of
    these sizes does the point look, so it is copied no oftener than there are scopes that hold it.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col(end) - F.col(begin) + 1))).cast("int")
    held = scopes.filter(F.col(begin) <= F.col(end)).select(key, begin, end, *carry, level.alias("_level"))
    sizes = sorted(r._level for r in held.select("_level").distinct().collect())  # 64 at most
    if not sizes:
        return points.join(held.drop("_level"), key).limit(0)
    found = _looking(points, held, key, at, begin, end, sizes).withColumn("_block", _block(at, F.col("_level")))
    found = found.join(held.withColumn("_block", F.explode(_blocks(begin, end, F.col("_level")))), [key, "_level", "_block"])
    return found.filter((F.col(begin) <= F.col(at)) & (F.col(at) <= F.col(end))).drop("_level", "_block")


def _block(place: str, size: Column) -> Column:
    return F.floor(F.col(place) / F.pow(F.lit(2.0), size)).cast("long")


def _blocks(begin: str, end: str, size: Column) -> Column:
    return F.array_distinct(F.array(_block(begin, size), _block(end, size)))


def _looking(points: DataFrame, held: DataFrame, key: str, at: str, begin: str, end: str, sizes: list[int]) -> DataFrame:
    """Each point once for each size (``_level``) of which a scope holds it; where there are two sizes at most, once for each of these."""
    if len(sizes) <= 2:
        return points.withColumn("_level", F.explode(F.array(*map(F.lit, sizes))))
    largest = F.lit(sizes[-1])
    ends = held.select(key, F.col(begin).alias("_at"), F.col(end).alias("_end"), "_level", F.explode(_blocks(begin, end, largest)).alias("_stretch"))
    rows = points.withColumns({"_at": F.col(at), "_stretch": _block(at, largest)}).unionByName(ends, allowMissingColumns=True)
    begun = W.partitionBy(key, "_stretch").orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    open_ = F.array_compact(F.array(*(F.when(F.max(F.when(F.col("_level") == size, F.col("_end"))).over(begun) >= F.col("_at"), F.lit(size)) for size in sizes)))
    return rows.withColumn("_open", open_).filter("_level is null").select(*points.columns, F.explode("_open").alias("_level"))


def innermost(points: DataFrame, scopes: DataFrame, key: str, at: str, begin: str, end: str, carry: list[str]) -> DataFrame:
    """Of each point the scope of its key that holds it and begins last; NULLs if none does.

    Points need an id column ``point_id``. Of scopes that begin alike the one that ends first wins, then the smallest carried values.
    """
    found = containing(points.select("point_id", key, at), scopes, key, at, begin, end, carry)
    rank = F.struct(-F.col(begin).cast("double"), F.col(end), *carry)
    best = found.groupBy("point_id").agg(F.min_by(F.struct(begin, end, *carry), rank).alias("_best"))
    return points.join(best, "point_id", "left").select(*points.columns, *(F.col(f"_best.{c}").alias(c) for c in (begin, end, *carry)))


def latest_before(points: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """``value`` of the last mark of the same keys at or before each point (as-of backward); NULL if there is none.

    Points and marks go through one sort by key and place: no pair of them is made.
    """
    left = points.select("*", F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema[value].dataType).alias("_value"))
    right = marks.select(*keys, at, F.lit(0).alias("_kind"), F.col(value).alias("_value"))
    w = W.partitionBy(*keys).orderBy(at, "_kind", F.col("_value")).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = left.unionByName(right, allowMissingColumns=True)
    seen = F.last(F.when(F.col("_kind") == 0, F.struct("_value")), ignorenulls=True).over(w)
    return both.withColumn("_seen", seen).filter("_kind = 1").select(*points.columns, F.col("_seen._value").alias(value))


def channel_pairs(channels: DataFrame, key: str = "key") -> DataFrame:
    """Writers and readers of one key that no call connects: kind, key, writer, reader. One writer of several in a file: the first."""
    writes = channels.filter("role = 'write'").groupBy("kind", key, "file").agg(F.min("fn_id").alias("writer"))
    reads = channels.filter("role = 'read'").select("kind", key, F.col("file").alias("reader_file"), F.col("fn_id").alias("reader")).distinct()
    return writes.withColumnRenamed("file", "writer_file").join(reads, ["kind", key]).filter("writer != reader")


def unresolved_match(writes: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """Equal keys, and files that are equal or unknown on either side (``file`` NULL)."""
    r = reads.withColumnRenamed("file", "reader_file")
    return writes.join(r, keys).filter(F.col("file").isNull() | F.col("reader_file").isNull() | (F.col("file") == F.col("reader_file")))


def partners(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row of one role with how many different ones of the other role have its keys, and the least of these, itself left out.

    rows: keys, role (read or write), fn_id. Rows: keys, role, fn_id, ``partners``, ``first_partner``; those without a partner are left
    out. A class of many writers and many readers makes as many rows as it has members, never their pairs.
    """
    rows = cut(rows.filter("role in ('read', 'write')").select(*keys, "role", "fn_id").dropna().distinct())
    other = F.when(F.col("role") == "read", "write").otherwise("read").alias("role")
    first = rows.groupBy(*keys, "role").agg(F.count("*").alias("many"), F.min("fn_id").alias("least"))
    beyond = rows.join(first.select(*keys, "role", F.col("least").alias("fn_id")), [*keys, "role", "fn_id"], "left_anti").groupBy(*keys, "role").agg(F.min("fn_id").alias("second"))
    known = first.join(beyond, [*keys, "role"], "left").select(*keys, other, "many", "least", "second")
    own = rows.select(*keys, other, "fn_id", F.lit(1).alias("_own"))
    out = rows.join(known, [*keys, "role"]).join(own, [*keys, "role", "fn_id"], "left")
    out = out.select(*keys, "role", "fn_id", (F.col("many") - F.coalesce("_own", F.lit(0))).alias("partners"), F.when(F.col("least") == F.col("fn_id"), F.col("second")).otherwise(F.col("least")).alias("first_partner"))
    return out.filter("partners > 0")


def unresolved_classes(writes: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """What ``unresolved_match`` pairs, by classes of equal keys and file: keys, writer_file, reader_file, writers, readers, first_writer, first_reader.

    writes: keys, file, writer; reads: keys, file, reader. Known files meet by equality, unknown ones (NULL) meet each class of the key once.
    """
    w = cut(writes.groupBy(*keys, F.col("file").alias("writer_file")).agg(F.count("*").alias("writers"), F.min("writer").alias("first_writer")))
    r = cut(reads.groupBy(*keys, F.col("file").alias("reader_file")).agg(F.count("*").alias("readers"), F.min("reader").alias("first_reader")))
    columns = [*keys, "writer_file", "reader_file", "writers", "readers", "first_writer", "first_reader"]
    same = w.join(r.withColumn("writer_file", F.col("reader_file")), [*keys, "writer_file"]).select(columns)
    from_unknown = w.filter("writer_file is null").join(r, keys).select(columns)
    to_unknown = w.filter("writer_file is not null").join(r.filter("reader_file is null"), keys).select(columns)
    return same.unionByName(from_unknown).unionByName(to_unknown)


def bypasses(calls: DataFrame, wrappers: DataFrame, least_uses: int = 3, least_files: int = 2) -> DataFrame:
    """Direct calls of a primitive that most callers reach through a wrapper.

    calls: file, callee; wrappers: wrapper, primitive, file (where it is defined). A wrapper counts when used so
    often and from so many files; calls inside the wrapper's own file are its business.
    """
    uses = calls.withColumnRenamed("callee", "wrapper").groupBy("wrapper").agg(F.count("*").alias("uses"), F.count_distinct("file").alias("files"))
    trusted = wrappers.withColumnRenamed("file", "own_file").join(uses.filter((F.col("uses") >= least_uses) & (F.col("files") >= least_files)), "wrapper")
    return calls.withColumnRenamed("callee", "primitive").join(trusted, "primitive").filter("file != own_file")


def bound_parameter(params: Column, position: Column, keyword: Column) -> Column:
    """Index of the parameter that an argument fills: by keyword, else by place, one further if the first is the receiver."""
    receiver = F.coalesce(params[0].isin("self", "cls", "this"), F.lit(False)).cast("int")
    by_name = F.array_position(params, keyword) - 1
    by_place = position + receiver
    return F.when(keyword.isNotNull(), F.when(by_name >= 0, by_name)).when(by_place < F.size(params), by_place)


def near_lines(found: DataFrame, expected: DataFrame, reach: int = 15) -> DataFrame:
    """Findings with expected sinks of the same path and CWE at most ``reach`` lines away.

    found: path, line, cwe; expected: sink_id, path, line_hint, cwe. Lines meet by blocks of ``reach`` + 1, so a
    file with very many findings is not paired as a whole.
    """
    size = reach + 1
    left = found.withColumn("_block", F.floor(F.col("line") / size))
    right = expected.withColumn("_block", F.explode(F.sequence(F.floor((F.col("line_hint") - reach) / size), F.floor((F.col("line_hint") + reach) / size))))
    return left.join(right, ["path", "cwe", "_block"]).filter(F.abs(F.col("line") - F.col("line_hint")) <= reach).drop("_block")


def re_exports(names: DataFrame, exports: DataFrame, definitions: DataFrame, most: int = 5) -> DataFrame:
    """Where a name is really defined. names: file, name; definitions: file, name; exports: file, name, place, target_file, target_name.

    Where a file doesn't define a name itself, its re-exports are followed: those of the name, and those of everything (``name``
    NULL, as in ``export *``, which hand the name on as it is). Ways are tried in the order of ``place``, each to its end, and the
    first that ends at a definition counts. At most ``most`` steps; a way that meets a file and name again, or ends in the open, gives nothing.
    Adds ``final_file`` and ``final_name``, NULL where no definition is found.
    """
    place = lambda prefix="": [F.col("file").alias(f"{prefix}file"), F.col("name").alias(f"{prefix}name")]
    defined = cut(definitions.select(*place("at_")).distinct().withColumn("_defined", F.lit(True)))
    named = exports.filter("name is not null").select(*place("at_"), "place", "target_file", "target_name")
    stars = exports.filter("name is null").select(F.col("file").alias("at_file"), "place", "target_file")
    ways = names.select("file", "name").distinct().select("file", "name", *place("at_"), F.array().cast("array<int>").alias("way"), F.array(F.concat_ws("#", "file", "name")).alias("_seen"))
    found: list[DataFrame] = []
    for step in range(most + 1):
        ways = cut(ways.join(defined, ["at_file", "at_name"], "left"))
        found.append(ways.filter("_defined").select("file", "name", "at_file", "at_name", "way"))
        open_ = ways.filter("_defined is null").drop("_defined")
        if step == most or open_.isEmpty():
            break
        next_ = open_.join(named, ["at_file", "at_name"]).unionByName(open_.join(stars, "at_file").withColumn("target_name", F.col("at_name")))
        key = F.concat_ws("#", "target_file", "target_name")
        ways = next_.filter(~F.array_contains("_seen", key)).select(
            "file", "name", F.col("target_file").alias("at_file"), F.col("target_name").alias("at_name"), F.array_append("way", F.col("place").cast("int")).alias("way"), F.array_append("_seen", key).alias("_seen")
        )
    first = reduce(DataFrame.unionByName, found).groupBy("file", "name").agg(F.min_by(F.struct("at_file", "at_name"), "way").alias("_f"))
    return names.join(first, ["file", "name"], "left").select(*names.columns, F.col("_f.at_file").alias("final_file"), F.col("_f.at_name").alias("final_name"))


def sole_owners(calls: DataFrame, methods: DataFrame, most: int) -> DataFrame:
    """Calls on receivers of unknown type, with every class that defines the method, if 1 to ``most`` do."""
    few = methods.groupBy("method").agg(F.count("*").alias("_n")).filter(F.col("_n") <= most).select("method")
    return calls.join(methods.join(few, "method"), "method")


def implementers(interfaces: DataFrame, types: DataFrame) -> DataFrame:
    """Types that have all of an interface's methods. Rows: interface, method; type, method. Types that share no method never meet."""
    need = interfaces.distinct().groupBy("interface").agg(F.count("*").alias("_need"))
    have = interfaces.distinct().join(types.distinct(), "method").groupBy("interface", "type").agg(F.count("*").alias("_have"))
    return have.join(need, "interface").filter("_have = _need").select("interface", "type")


def zipped(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with the answers of the same place. asked: batch, items array; answers: batch, results array (NULL: not answered).

    An answer that is missing stays NULL, "not checked", and is never an empty one.
    """
    left = asked.select("batch", F.posexplode("items").alias("place", "item"))
    right = answers.select("batch", F.posexplode_outer("results").alias("place", "result"))
    return left.join(right, ["batch", "place"], "left")


def not_yet_reported(found: DataFrame, reported: DataFrame, reach: int = 3) -> DataFrame:
    """Findings less those that stand where one is reported: on the same line, or near it with a shared CWE (array)."""
    size = reach + 1
    left = found.withColumn("_block", F.floor(F.col("line") / size))
    right = reported.select("path", F.col("line").alias("_line"), F.col("cwe").alias("_cwe"))
    right = right.withColumn("_block", F.explode(F.sequence(F.floor((F.col("_line") - reach) / size), F.floor((F.col("_line") + reach) / size))))
    near = (F.abs(F.col("line") - F.col("_line")) <= reach) & F.coalesce(F.arrays_overlap("cwe", "_cwe"), F.lit(False))
    cond = (left["path"] == right["path"]) & (left["_block"] == right["_block"]) & ((left["line"] == right["_line"]) | near)
    return left.join(right, cond, "left_anti").drop("_block")
