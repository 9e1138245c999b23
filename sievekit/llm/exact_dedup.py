"""Exact duplicates by progressive refinement: length, then a hash of the head, then the full hash.

Each level reads a little more of a text, and only for groups that still have several members.
What survives a level is handed to the next one as a bitmap of hashed group keys. A bitmap has a
fixed size, whatever the number of groups, so it can be broadcast; a false positive in it only
costs one more hash. No level shuffles a text: groups are counted with map-side partial sums, so a
group that holds a third of all rows arrives as one row from each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm.bitmap import BITS, bitmap, marked
from sievekit.llm.common import ascii_lower, cut

HEAD_CHARS = 256


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_chars: int = HEAD_CHARS, filter_bits: int = BITS,
    digest_all: bool = False,
) -> DataFrame:
    """One row for each row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``full_hash``.

    ``digest_all`` adds ``text_sha256``, the same hash for every row, for callers that want it as output.

    Texts are equal when identical after lower-casing A-Z only; a null text counts as empty. Of equal
    texts the row with the largest id stays. ``full_hash`` (SHA-256, lower-case hex, of the normalised
    text) is null where the length or the head already shows that a text has no equal.

    Rows with a null id belong to their group and count in its size; they are kept only if the group has
    no other id. Repeated rows of one id are kept or dropped together. Other columns are ignored; an empty
    table gives an empty result. Very long texts are hashed whole, inside the row.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_length", F.octet_length("_text"))

    lengths = rows.groupBy("_length").count().filter("count > 1")
    by_length = bitmap(lengths, "_length", bits=filter_bits)
    level2 = marked(rows, by_length, "_length", bits=filter_bits)
    level2 = level2.withColumn("_head", F.when(F.col("_in"), F.xxhash64(ascii_lower(F.substring("_text", 1, head_chars)))))

    heads = level2.filter("_in").groupBy("_length", "_head").count().filter("count > 1")
    by_head = bitmap(heads, "_length", "_head", bits=filter_bits)
    level3 = marked(level2.withColumnRenamed("_in", "_in2"), by_head, "_length", "_head", bits=filter_bits)
    full = F.sha2(ascii_lower(F.col("_text")), 256)
    hashed = level3.select(
        "_id",
        F.when(F.col("_in2") & F.col("_in"), full).alias("full_hash"),
        *([full.alias("text_sha256")] if digest_all else []),
    )
    # A reliable cut: the hashes are made once, and both sides of the join below are dealt by Spark, which
    # lets it split a partition in which one hash has very many rows.
    hashed = cut(hashed)

    groups = hashed.filter("full_hash is not null").groupBy("full_hash").agg(F.max("_id").alias("_keep"), F.count("*").alias("_size"))
    groups = cut(groups.filter("_size > 1"))
    alone = hashed.withColumn("_hash", F.coalesce("full_hash", F.xxhash64("_id").cast("string")))
    found = alone.join(groups.withColumnRenamed("full_hash", "_hash"), "_hash", "left")
    keep = F.when(F.col("_size").isNotNull(), F.col("_keep")).otherwise(F.col("_id"))
    return found.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        "full_hash",
        *(["text_sha256"] if digest_all else []),
    )
