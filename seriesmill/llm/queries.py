"""The operators as queries over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import bpe, chat, fim, iblt, importance, main_text, mixing, near_join, onebit, packing, target_sampling, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages. The label of a page is that of the document with its id; bad is low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.select(F.col("doc_id").alias("page_id"), F.coalesce(bad, F.lit(False)).alias("bad"))
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), known).drop("mined_rule")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"))


def op5_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_classes(table(spark, sf_dir, "documents"))


def op6_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chats(table(spark, sf_dir, "conversations"))


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


def op9_onebit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.neighbours(table(spark, sf_dir, "embeddings"))


def op10_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("row_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    text = fim.restored(F.col("output"), F.col("form"))
    return made.withColumn("restored_sha256", F.sha2(text, 256)).withColumn("output_sha256", F.sha2("output", 256)).drop("output")


def op12_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_sampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_source_mix, op3_fingerprints, op4_token_counts, op5_near_join,
        op6_chat_snapshots, op7_importance, op8_warc_revisits, op9_onebit_search, op10_bin_packing,
        op11_fill_in_middle, op12_target_sampling, op13_main_text,
    )
}
