"""What the training-data operators share: reading, Arrow mapping and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from sievekit.llm.bitmap import bitmap, marked

#: Rows handled at once inside a task. An Arrow batch is already bounded in bytes by Spark.
SLICE_ROWS = 256


_TABLES: dict[str, object] = {}


def worker_table(key: str, make: Callable[[], object]) -> object:
    """A large table for all tasks that a worker runs one after the other. There is one at a time: a new one takes its place."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = make()
    return _TABLES[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which a cluster shares between all machines.

    Only where that is unset on a single machine (local mode) a temporary folder is made; elsewhere it is an error.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="sievekit-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, in the shared folder, and drop its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list, list[str]], dict[str, list]]],
    columns: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Apply a per-task function to ids and whole texts (null: empty) in Arrow slices.

    ``make`` runs once in each task and returns the function of a slice; that one gets the ids,
    the texts and the ``keep`` columns' values as lists and returns column lists of equal length,
    which may be longer or shorter than the input.
    """
    fields = [StructField(id_col, docs.schema[id_col].dataType), *_parse_datatype_string(columns).fields]
    out = StructType(fields)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        apply = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                if apply is None:
                    apply = make()
                ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                made = apply(ids, texts, *(part.column(2 + k).to_pylist() for k in range(len(keep))))
                made.setdefault(id_col, ids)
                yield pa.RecordBatch.from_arrays([pa.array(made[n], type=arrow.field(n).type) for n in names], schema=arrow)

    return docs.select(id_col, text_col, *keep).mapInArrow(run, out)


def ascii_lower(text: F.Column) -> F.Column:
    """Lower-case A-Z only. Pure ASCII texts take the engine's byte-wise path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def remainder(doc_id: F.Column, divisor: int) -> F.Column:
    """crc32 of the id written as text, modulo ``divisor``: the folds of the labelled queries."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet files in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose id is in ``dropped``; rows without an id stay.

    A bitmap of the dropped ids lets every other row pass in the scan. Only rows that may be dropped are joined.
    All columns travel as one, so theirs may have any names.
    """
    dropped = cut(dropped.select(F.col(id_col).alias("_id")).distinct())
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    rows = marked(rows, bitmap(dropped, "_id"), "_id")
    sure, open_ = rows.filter("not _in"), rows.filter("_in")
    return sure.select("_row.*").unionByName(open_.join(dropped, "_id", "left_anti").select("_row.*"))


def at_least(rows: DataFrame, count_col: str, most: int) -> DataFrame:
    """The rows with the greatest counts, ``most`` of them at most: all whose count reaches a bound that a histogram gives.

    The histogram has eight bins for each doubling, over the whole range. Counts of one bin stay or go together; no
    task ever sorts or holds the candidates of the others. Counts below 1 never stay.
    """
    bin_ = F.floor(F.log2(F.col(count_col)) * 8)
    rows = rows.filter(F.col(count_col) >= 1)
    found = {r.b: r["count"] for r in rows.groupBy(bin_.alias("b")).count().collect()}  # 8 x 63 rows at most
    bound, sum_ = None, 0
    for b in sorted(found, reverse=True):
        sum_ += found[b]
        if sum_ > most:
            break
        bound = b
    return rows.filter(F.lit(False) if bound is None else bin_ >= bound)


def share_of(rows: DataFrame, n: int, id_col: str, salt: int) -> DataFrame:
    """About ``n`` rows, and never more, chosen by a hash of the id: the same ones in every run, from all over the table."""
    total = rows.count()
    if total <= n:
        return rows
    place = F.pmod(F.xxhash64(F.lit(salt), id_col), F.lit(1 << 30))
    return rows.filter(place < int((1 << 30) * 0.97 * n / total)).limit(n)
