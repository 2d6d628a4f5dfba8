"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.mixing import mixing_sql, probabilities


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, by: int) -> Column:
    """crc32 of the identifier as text, modulo `by`; a null identifier counts as remainder -1 and is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % by, F.lit(-1))


def op1_class_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.llm.brown_lm import score_texts

    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 7) == 2
    return score_texts(docs, ~held_out).withColumn("held_out", held_out)


def op2_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.llm.toxicity import score_texts, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = train(docs, labels.filter(remainder("doc_id", 3) != 1))
    return score_texts(docs, machine).withColumn("held_out", remainder("doc_id", 3) == 1)


def op3_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.llm.edit_counts import recount

    return recount(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.llm.exact_dedup import exact_dedup

    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op5_mixing_by_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probabilities(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2).withColumnRenamed("id", "doc_id")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op8_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.llm.language_id import predict_languages

    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 0
    return predict_languages(docs, docs.filter(~held_out)).withColumn("held_out", held_out)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op10_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.llm.flac import digests

    return digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_class_ngram_scores": op1_class_ngram_scores,
    "op2_string_kernel_toxicity": op2_string_kernel_toxicity,
    "op3_edit_aware_counts": op3_edit_aware_counts,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing_by_raking": op5_mixing_by_raking,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_nearest_centroid_language": op8_nearest_centroid_language,
    "op9_license_scan": op9_license_scan,
    "op10_flac_media": op10_flac_media,
}

ORACLE_SQL = {
    "op5_mixing_by_raking": mixing_sql(),
    "op4_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)
    """,
}
