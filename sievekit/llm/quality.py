"""Quality by compression: which of two dictionaries, one of good text and one of bad, describes a text more shortly?

A text is compressed in blocks, each block by itself with either dictionary, so that a long text's own history
doesn't hide the dictionaries. The difference of the two sizes for each byte is calibrated to a probability on
labelled texts that the dictionaries haven't seen, together with the size for each byte: text that repeats itself
is short with either dictionary, and the difference alone lets a quarter of the bad texts pass.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import SLICE_ROWS, cut, map_texts, share_of, worker_table
from sievekit.llm.logistic import Logistic

BLOCK = 1024
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
#: Bounds of the sample that is fitted: labelled rows and blocks of them (from anywhere in their texts) for either
#: dictionary, and labelled rows for the calibration.
ROWS_OF_CLASS = 2500
BLOCKS_OF_CLASS = 12_000
CALIBRATION_ROWS = 5000


def blocks(data: bytes) -> list[bytes]:
    return [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)] or [b""]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        def load(data: bytes) -> zstandard.ZstdCompressor:
            held = zstandard.ZstdCompressionDict(data)
            held.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good, self.bad = load(good), load(bad)

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 2))
        for k, text in enumerate(texts):
            parts = blocks(text.encode())
            good = sum(len(self.good.compress(p)) for p in parts)
            bad = sum(len(self.bad.compress(p)) for p in parts)
            size = sum(map(len, parts)) + 1
            out[k] = (bad - good) / size, good / size
        return out


def dictionary(samples: list[bytes]) -> bytes:
    """Trained on the samples, or their plain bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\0" * 8


def _samples(texts: DataFrame, chosen: DataFrame) -> list[bytes]:
    """Blocks of the chosen rows' whole texts, BLOCKS_OF_CLASS of them at most."""

    def make():
        return lambda ids, texts: {"part": [list(enumerate(blocks(text.encode()))) for text in texts]}

    rows = texts.join(F.broadcast(chosen.select("_id")), "_id").dropDuplicates(["_id"])  # bounded by ROWS_OF_CLASS
    made = map_texts(rows, make, "part array<struct<at: int, block: binary>>", "_id", "_text").select("_id", F.explode("part").alias("part"))
    made = cut(made.select(F.struct("_id", "part.at").alias("key"), "part.block"))
    found = share_of(made, BLOCKS_OF_CLASS, "key", 4).select("block").toPandas()["block"]
    return sorted(map(bytes, found))


def _dictionary_of(samples: list[bytes], seed: int = 5) -> bytes:
    kept = [p for p in samples if len(p) > 16]
    random.Random(seed).shuffle(kept)
    return dictionary(kept)


class QualityModel:
    def __init__(self, good: bytes, bad: bytes, calibration: Logistic):
        self.good, self.bad, self.calibration = good, bad, calibration
        self.key = hashlib.sha256(good + b"|" + bad).hexdigest()


def _compressors(model: QualityModel) -> Compressors:
    return worker_table(model.key, lambda: Compressors(model.good, model.bad))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Dictionaries and calibration from the labelled rows for which ``usable`` holds.

    ``labels`` has the id and ``label_col`` (1 good, 0 bad; null: unlabelled). Rows for the dictionaries and for
    the calibration are apart. The rows used are bounded by ROWS_OF_CLASS and CALIBRATION_ROWS; of several rows with
    one id, one is used.
    """
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"), usable.alias("_usable"))
    own = cut(own.filter(F.col("_usable") & F.col("_label").isin(0, 1) & F.col("_id").isNotNull()).dropDuplicates(["_id"]).select("_id", "_label"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    for_fit = F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(2)) == 0
    good, bad = (_dictionary_of(_samples(texts, share_of(own.filter(for_fit & (F.col("_label") == k)), ROWS_OF_CLASS, "_id", 2))) for k in (1, 0))
    bare = QualityModel(good, bad, Logistic(np.zeros((0, 2)), np.zeros(0)))
    held = share_of(own.filter(~for_fit), CALIBRATION_ROWS, "_id", 3)

    def make():
        compressors = _compressors(bare)

        def apply(ids: list, texts: list[str], labels: list[int]) -> dict[str, list]:
            return {"label": labels, "features": compressors.features(texts).tolist()}

        return apply

    rows = texts.join(F.broadcast(held), "_id").dropDuplicates(["_id"])  # bounded by CALIBRATION_ROWS
    found = map_texts(rows, make, "label int, features array<double>", "_id", "_text", keep=("_label",)).collect()
    data = np.array(sorted((r.label, *r.features) for r in found), dtype=float).reshape(len(found), 3)
    return QualityModel(good, bad, Logistic(data[:, 1:], data[:, 0]))


def quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id and ``score`` from 0 to 1, higher for text that is more likely good.

    The score depends on the whole text alone, however long; a null text counts as empty and gets the score of nothing.
    Equal texts, and so repeated rows, get equal scores. If the labels hold one class only, every score is that class's
    share. Other columns aren't read, whatever their names; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 64 KB

    def make():
        model = sent.value
        compressors = _compressors(model)

        def apply(ids: list, texts: list[str]) -> dict[str, list]:
            return {"score": model.calibration.score(compressors.features(texts))}

        return apply

    return map_texts(docs, make, "score double", id_col, text_col)


def keep_good(docs: DataFrame, model: QualityModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``least``. Nothing is shuffled.

    Scores are those of ``quality()``: null and empty texts have the score of nothing, repeated rows stay or go
    together, as does everything with a score of exactly ``least`` (it stays). An empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 64 KB
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        compressors = _compressors(model)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                scores = model.calibration.score(compressors.features([t or "" for t in part.column(at).to_pylist()]))
                yield part.filter(pa.array(scores >= least))

    return docs.mapInArrow(run, docs.schema)
