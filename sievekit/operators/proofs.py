"""Proofs for all: a value is bounded only if everything that it can come from is.

Rules are Horn clauses: a value has alternative definitions, and each definition has premises. A value is proven once all
of its definitions are, a definition once all of its premises are. Both are counted: what has no open premise left is
proven, lowers the counts of what rests on it, and so on. What rests on itself is never lowered to 0 and stays unproven.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievekit.operators.graph import Fronts
from sievekit.operators.materialise import stored

#: Kinds of values: numbers, bounded texts, and what can't be said.
NUMBER, TEXT, UNKNOWN = "number", "text", "unknown"
#: What an expression of bounded parts is: a number only of numbers; text of numbers and texts.
#: copy: its one part; join: adds texts, so no number among them; format: renders any bounded part; character: renders a number as a
#: character, which isn't bounded; convert: a number whatever goes in.
OPERATIONS = ("copy", "arithmetic", "join", "format", "character", "convert")
#: Those that are bounded if their parts are.
_OF_PARTS = ("copy", "arithmetic", "join", "format")


def bounded(definitions: DataFrame, premises: DataFrame) -> DataFrame:
    """``value`` and ``kind`` (number or text) of each value that is proven to be bounded.

    definitions: value, definition, operation (one of OPERATIONS, else unknown) and ``literal`` (number, text, unknown, or NULL
    where it has parts); premises: definition, part (a value). A definition with neither literal nor parts is unknown, but for
    convert. A value that has definitions of both kinds is unknown, as is one without any.

    One pass by value tells those that have no chance whatever their parts are: a definition is never bounded, or one can only be a
    number and another only text. Of the others only open definitions are written and meet their premises. A value proven in one
    round is joined once with the premises that name it; in each round only its definitions' counts are written.
    """
    operation, literal = F.col("operation"), F.col("literal")
    shape = F.when(operation == "convert", NUMBER).when(literal.isin(NUMBER, TEXT), literal).when(literal.isNull() & operation.isin(*_OF_PARTS), operation).otherwise(UNKNOWN)
    number, text, open_ = (F.col("shape").isin(*x) for x in ((NUMBER, "arithmetic"), (TEXT, "join", "format"), _OF_PARTS))
    of_value = W.partitionBy("value")
    given = definitions.filter("value is not null").select("value", "definition", "operation", shape.alias("shape")).repartition("value").distinct()
    given = given.select(
        "*", open_.alias("_open"), F.bool_or((F.col("shape") == UNKNOWN)).over(of_value).alias("_never"), F.bool_or(number).over(of_value).alias("_number"), F.bool_or(text).over(of_value).alias("_text"),
        F.count_if(open_).over(of_value).alias("open"), F.max(F.when(~open_, F.col("shape"))).over(of_value).alias("base"),
    ).filter("not _never and not (_number and _text) and (_open or open = 0)")
    # Of a value without open definitions one row, of others one for each of these; ``base``: the kind of its literals.
    given = stored(given.select("value", *(F.when(F.col("_open"), F.col(c)).alias(c) for c in ("definition", "operation")), "open", "base").distinct())
    asked = given.filter("open > 0").join(premises.select("definition", "part"), "definition").distinct()
    key = ["definition", "value", "operation", "need", "open", "base"]
    parts = stored(asked.withColumn("need", F.count("*").over(W.partitionBy("definition", "value", "operation"))).select(*key, "part"))
    front = stored(given.filter("open = 0").select("value", F.col("base").alias("kind")))
    proven = Fronts(front)
    met: Fronts | None = None
    done: Fronts | None = None
    only = F.col("numbers") == F.col("n")
    kind = (
        F.when(operation == "copy", F.when(only, NUMBER).when(F.col("numbers") == 0, TEXT))
        .when(operation == "arithmetic", F.when(only, NUMBER))
        .when(operation == "join", F.when(F.col("numbers") == 0, TEXT))
        .when(operation == "format", F.lit(TEXT))
    )
    while not front.isEmpty():
        hits = parts.join(front.select(F.col("value").alias("part"), "kind"), "part").groupBy(*key).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == NUMBER).alias("numbers"))
        hits = stored(hits)
        met = _with(met, hits)
        sums = met.all().join(hits.select("definition").distinct(), "definition", "left_semi").groupBy(*key).agg(F.sum("n").alias("n"), F.sum("numbers").alias("numbers"))
        shown = sums.filter("n = need").select("value", "open", "base", kind.alias("kind")).dropna(subset=["kind"])
        shown = stored(shown.groupBy("value", "open", "base", "kind").agg(F.count("*").alias("n")))
        done = _with(done, shown)
        counts = done.all().join(shown.select("value").distinct(), "value", "left_semi").groupBy("value", "open", "base").agg(F.sum("n").alias("n"), F.min("kind").alias("kind"), F.max("kind").alias("_other"))
        # A value's last definition is shown once, so no value is proven twice.
        front = stored(counts.filter("n = open and kind = _other and (base is null or base = kind)").select("value", "kind"))
        proven.add(front)
    return proven.all()


def _with(fronts: Fronts | None, rows: DataFrame) -> Fronts:
    if fronts is None:
        return Fronts(rows)
    fronts.add(rows)
    return fronts


def without_bounded(findings: DataFrame, logged: DataFrame, proven: DataFrame, rule: str = "TNT-LOG-001") -> DataFrame:
    """``findings`` less those of ``rule`` at lines where everything logged is bounded. logged: path, line, value (NULL: can't be named).

    A line of which nothing is known keeps its findings.
    """
    rows = logged.join(proven.select("value", F.lit(1).alias("_ok")).distinct(), "value", "left")
    safe = rows.groupBy("path", "line").agg(F.count("*").alias("n"), F.count("_ok").alias("ok")).filter("n = ok").select("path", "line")
    marked = findings.join(safe.withColumn("_safe", F.lit(True)), ["path", "line"], "left")
    return marked.filter(~(F.coalesce("_safe", F.lit(False)) & (F.col("rule_id") == rule))).select(*findings.columns)
