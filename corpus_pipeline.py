"""The corpus pipeline: quality, language, near duplicates, packing.

Each stage takes what its predecessor kept and returns the columns of
``documents`` (the last: the packed pieces). Models learn from the stage's own
input. Null and empty texts: the quality stage scores them as an empty passage,
the language stage drops them, as it does any without a letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairflow.llm import language, near_dups, packing, quality
from pairflow.llm.common import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.good_documents(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    return language.documents_with_language(docs, language.learn(docs))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, linked from a similarity of 0.8."""
    return near_dups.deduplicated(docs, near_dups.STAGE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left as pieces of training sequences."""
    return packing.packed(docs)


STAGES = [("quality", keep_good), ("language", keep_languages), ("near_duplicates", keep_first_copies), ("packing", pack_sequences)]
#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is a table that the next reads."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
