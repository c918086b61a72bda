"""The eleven registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecotone.llm import bpe, chat, fingerprint, licenses, mixing, simhash, suffixes, toxicity, urls, vectors


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer() -> tuple[dict, str]:
    """Ranks and pattern of the tokenizer that the queries use; its file is installed beside the engine, not part of it."""
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), *tokenizer())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op4_suffix_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.passages(_read(spark, sf_dir, "documents"))


def op5_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


#: The conversation that the contract adds: texts that hold template strings.
ADDED = (-7, "\\### Assistant: </turn> ok")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(ADDED[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED[1]).alias("text"))
    return chat.digest(chat.format_chats(rows.unionByName(added)))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.near_edited(_read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_url_filters": op3_url_filters,
    "op4_suffix_passages": op4_suffix_passages,
    "op5_embedding_duplicates": op5_embedding_duplicates,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_license_scans": op8_license_scans,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_fingerprints": op10_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filters": urls.SQL,
    "op7_mixing": mixing.SQL,
}
