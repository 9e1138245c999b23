"""Sets of hashed keys as bitmaps of a fixed size, made and asked with SQL functions.

A bitmap lets rows that surely have no partner leave before a shuffle. Its size depends on the number of
bits alone, so it may be broadcast whatever the number of keys; too many keys only let more rows through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1 << 24 bits are 2 MB. More bits keep more single rows out.
BITS = 1 << 24


def _bit(*key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(bits)) + 1


def bitmap(keys: DataFrame, *key: str, bits: int = BITS) -> DataFrame:
    """At most bits / 32768 rows of 4 KB, one for each bucket of bit numbers that has a bit set."""
    return (
        keys.select(_bit(*map(F.col, key), bits=bits).alias("_bit"))
        .groupBy(F.bitmap_bucket_number("_bit").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bitmap"))
    )


def marked(rows: DataFrame, held: DataFrame, *key: str, bits: int = BITS) -> DataFrame:
    """``rows`` with a boolean ``_in``: is its key's bit set?"""
    rows = rows.withColumn("_bit", _bit(*map(F.col, key), bits=bits))
    rows = rows.withColumn("_bucket", F.bitmap_bucket_number("_bit")).withColumn("_pos", F.bitmap_bit_position("_bit"))
    byte = "cast(conv(hex(substring(_bitmap, cast(_pos div 8 as int) + 1, 1)), 16, 10) as int)"
    joined = rows.join(F.broadcast(held), "_bucket", "left")  # bits / 8 bytes at most
    return joined.withColumn("_in", F.expr(f"coalesce(({byte} & shiftleft(1, cast(_pos % 8 as int))) != 0, false)")).drop(
        "_bit", "_bucket", "_pos", "_bitmap"
    )
