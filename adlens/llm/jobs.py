"""The operators applied to the whole sample tables, under the names the driver knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.llm import (
    chat, decision_list, decontaminate, html_text, learned_partitions, lexical_search, line_dedup, mixing, pii, quality_ranker,
    simhash, token_alignment, url_rules,
)
from adlens.llm.common import table


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(table(spark, folder, "documents"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.drop_repeated_lines(table(spark, folder, "documents"), counts=True)
    return cleaned.select("doc_id", "text", "n_lines", "n_removed", "n_links")


def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(table(spark, folder, "pages"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, folder, "pages"))


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations")
    trap = "\\### Assistant: </turn> ok"
    # no table holds this conversation; it is part of what is asked for
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(trap).alias("text"),
    )
    rows = given.select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_back(chat.format_conversations(rows))
    return read.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_ranker.rank_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = decision_list.judge_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.drop("rule")


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.replace_pii(table(spark, folder, "documents")).select("doc_id", "text", "n_entities")


def op11_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return learned_partitions.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.link_statistics(table(spark, folder, "documents"))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


JOBS = [
    op1_simhash, op2_line_dedup, op3_html_text, op4_mixing, op5_url_rules, op6_decontaminate, op7_chat, op8_quality,
    op9_rules, op10_pii, op11_nearest_vectors, op12_token_alignment, op13_lexical_search,
]


def queries() -> dict:
    return {job.__name__: job for job in JOBS}
