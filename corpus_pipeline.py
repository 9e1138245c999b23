"""From raw documents to token ids in five stages, each by one of the operators in sievekit.llm.

Every stage takes all rows that the one before has kept, reads whole texts, and is written as Parquet before
the next one begins, so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm import bpe, decontamination, exact_dedup, ngram_join, quality
from sievekit.llm.common import remainder, table, without, written


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more; learned from the labels outside the held-out fold.

    Null and empty texts have the score of nothing; repeated rows stay or go together; an empty table stays empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return quality.keep_good(docs, model, least=0.3)


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the largest id.

    Null and empty texts are equal. Rows of the id that stays all stay, so rows repeated whole do; rows without an id stay.
    """
    return without(docs, exact_dedup.exact_duplicates(docs).filter("not kept"))


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id.

    Null and empty texts, and rows without an id, are near to nothing and stay; rows of an id stay or go together.
    """
    return without(docs, ngram_join.near_duplicates(docs).filter("doc_id != component_id"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null and empty texts hold none; rows of an id stay or go together; rows without an id stay.
    """
    return without(docs, decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests that show that they decode to its text.

    A null or empty text has no ids; repeated rows give repeated rows; an empty table an empty result.
    """
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("quality classifier", good_only),
    ("exact dedup", one_of_equal),
    ("n-gram Jaccard join", one_of_near),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", token_ids),
]

#: The classifier, the near duplicates, the templates and the tokens have no SQL. Tests hold the operators against brute
#: force, the tokenizer's library or planted cases, and the stages against what each should keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
