"""From raw documents to training shards, in stages that each end in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pressgauge.llm import decontamination, jaccard, mixing, quality, shards
from pressgauge.llm.common import table
from pressgauge.session import fresh_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the model trained on the labelled ones."""
    return quality.kept_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles with a Jaccard similarity of 0.8 or more."""
    return jaccard.representatives(docs, n=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document taken twice is two rows."""
    return mixing.mixed_documents(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per sequence of the shards."""
    return shards.shards(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_shards),
]

# A trained model and a vocabulary decide here: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written and read before the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, function) in enumerate(STAGES):
        path = fresh_path(spark, f"pipeline-{number}")
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
