"""Cutting lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that a join may send whole through the driver to every task.
SENT = 100_000


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder (spark.checkpoint.dir, shared on a cluster; a temporary one where unset in local mode)."""
    _folder(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the same folder: columns are packed, and the planner knows its packed size. Where it may be large, joins ask ``side``."""
    path = f"{_folder(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side(table: DataFrame, rows: int | None = None, large: str = "merge") -> DataFrame:
    """A stored table (of ``rows`` rows if that is known) as one side of a join: sent whole if it has few rows, else met by a shuffle (``large``: of
    which kind; shuffle_hash only where a key has few rows).

    The planner goes by packed bytes, in proportion to the columns that are read. Repeated values take next to none, so a table of
    millions of rows would pass for a small one and fill the driver's memory.
    """
    rows = table.count() if rows is None else rows
    return F.broadcast(table) if rows <= SENT else table.hint(large)


def _folder(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="sievekit-checkpoint-"))
    return context.getCheckpointDir()
