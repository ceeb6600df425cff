"""The queries of this subpackage: one opN_<name> for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import chat, decontaminate, lattice, lm, mixing, near_dup, quality, resample, substrings, token_counts, token_files, urls, vector_codes
from trialweave.llm.sql import ORACLE_SQL
from trialweave.session import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def op1_score_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents", "doc_id", "text"), lm.held_out_by_crc(F.col("doc_id")))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(_table(spark, sf_dir, "documents", "doc_id", "text", "source")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id", "kept", F.col("n_words").cast("long").alias("n_words"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.link(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op7_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2, numPartitions=1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.format_conversations(rows.unionByName(more), public_tokenizers.path("byte_bpe_50k.json"))).drop("n_tokens", "n_loss_tokens")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict", "log_odds")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenized(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang", "n_chars"), _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "text"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_score_lm": op1_score_lm,
    "op2_mix_sources": op2_mix_sources,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_near_dup": op5_near_dup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_format_chats": op7_format_chats,
    "op8_url_filter": op8_url_filter,
    "op9_token_files": op9_token_files,
    "op10_quality": op10_quality,
    "op11_resample": op11_resample,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_counts": op13_token_counts,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
