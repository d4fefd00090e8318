"""The training-data pipeline: five stages over documents, each written as Parquet and read again for the next.

Every stage takes all rows that the one before kept. An empty table goes through empty. Further columns pass through all
stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake import ship
from tarnlake.llm import near_copies, op1_packing, op6_mixing, op7_toxicity, op10_language_id
from tarnlake.llm.common import empty_saved, saved_so_far, table
from tarnlake.sources.scratch import new_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows, with lang set to it; null, empty and letterless texts go. Repeated rows are judged each."""
    ship(spark)
    return op10_language_id.accepted(spark, docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language. Null texts score what no word does; repeated rows score alike."""
    return op7_toxicity.clean(spark, docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard likeness of 0.8 at least.

    The one of the smallest id stays (of the smallest text hash where ids tie; null ids last). Null and empty texts are
    one group. Texts that share an id and are no near copies all stay.
    """
    ship(spark)
    return near_copies.keep_one(spark, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the budget of their domain, language and source; null ones are a leaf of their own. Rows that share an id stand at one place of its order."""
    return op6_mixing.mixed(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, placed in sequences. A null or empty text is its end token; repeated rows are packed each."""
    ship(spark)
    return op1_packing.digest(op1_packing.pack(docs))


STAGES = [("language", language), ("toxicity", toxicity), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: Models, fingerprints and a tokenizer are beyond SQL; tests/llm/test_pipeline_plain.py and test_near_copies.py compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path, before = new_path(spark, f"pipeline-{name}"), saved_so_far()
        stage(spark, docs, sf_dir).write.parquet(path)
        empty_saved(spark, before)  # what the stage wrote on its way
        docs = spark.read.parquet(path)
    return docs
