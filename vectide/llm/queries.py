"""The operators as queries over the given tables, with their production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import encode
from .chat import format_chats
from .exact_dedup import exact_dedup
from .fingerprints import fingerprints
from .minhash_dedup import near_dedup
from .mixing import mix_sources
from .substring_dedup import cut_passages
from .token_counts import token_counts
from .token_store import token_store
from .toxicity import toxic_documents


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"), with_counts=True)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_read(spark, sf_dir, "conversations"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_read(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_read(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(_read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_passages(_read(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_mix_sources, op3_exact_dedup, op4_chat_formatting, op5_toxicity,
        op6_byte_bpe, op7_minhash_dedup, op8_token_store, op9_substring_dedup, op10_fingerprints,
    )
}
SQL: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, text, lang, source, n_chars
        FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS n FROM documents)
        WHERE n = 1 OR text IS NULL""",
}
