"""The pipeline's stages: (spark, docs, sf_dir) to the documents that stay, or, for the last, to packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled documents of sf_dir."""
    from sheaf.llm.toxicity import keep_clean

    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_clean(docs, source, labels)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest identifier stays."""
    from sheaf.llm.exact_dedup import MergeIndex

    return MergeIndex(docs).survivors()


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest identifier."""
    from sheaf.llm.near_dedup import keep_one

    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by probabilities that are calibrated to the target weights."""
    from sheaf.llm.mixing import sample_documents

    return sample_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from sheaf.llm.packing import pack_documents

    return pack_documents(docs)
