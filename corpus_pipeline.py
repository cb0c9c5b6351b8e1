"""From raw documents to packed training sequences: the stages in order, each a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesmill.llm import importance, mixing, near_join, packing
from seriesmill.llm.common import new_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the importance sample has; the others go."""
    return importance.resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id."""
    return near_join.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often, and as far, as it takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in a training sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram jaccard join", keep_distinct),
    ("source mix", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Importance, near duplicates and packing cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written and read again as the documents of the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
