"""A training corpus from raw documents: stages that each apply one operator to what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.
All but the last return the columns of documents, extra ones included. Empty input gives empty output at every stage. Rows are
told apart by id and text: null ids and ids that stand with several texts are rows like others; of equal rows near_duplicates
keeps one; null and empty texts fail the quality rules and go there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codequarry.llm.common import own_folder, remove_folder, table
from codequarry.llm.decontaminate import keep_clean
from codequarry.llm.jaccard import keep_first
from codequarry.llm.mixture import mix
from codequarry.llm.pii import sanitise
from codequarry.llm.quality import keep_good

#: Near duplicates share this percentage of their shingles of so many words.
SIMILAR_PERCENT, SIMILAR_WORDS = 80, 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and are no outliers of their language and source."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates."""
    return keep_first(docs, SIMILAR_PERCENT, SIMILAR_WORDS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and telling terms taken out of their texts."""
    return sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes."""
    return mix(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pii", pii), ("mixture", mixture)]

#: Robust estimates and inferred disclosure are iterative: the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is removed once the next one is written; the last goes with the application."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = own_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
