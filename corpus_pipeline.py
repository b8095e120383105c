"""A corpus pipeline of five stages: drop toxic documents, near duplicates and benchmark leaks, mix the sources to their
weights, and deal the result to shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents; the last adds `shard` and `slot`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalflow.llm.common import table
from evalflow.llm.decontamination import decontaminated
from evalflow.llm.jaccard import one_of_each
from evalflow.llm.mixing import mixed_documents
from evalflow.llm.sharding import shard
from evalflow.llm.toxicity import without_toxic
from evalflow.staging import owned, stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; it is trained on the labelled ones among ``docs``."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays, the one of smallest id."""
    return one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard and slot."""
    return shard(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A trained classifier cannot be stated in SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        # What a stage wrote for itself goes with it; its result stays for the next one.
        with owned(spark) as tables:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
            tables.pop()
    return docs
