"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat_format, decontaminate, exact_dedup, filter_audit, fingerprints, html_text, merkle, mixing, ngram_join, pieces, suffix_dedup, token_files, toxicity
from tidemark.llm.common import documents, tokenizer_file


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, folder), with_links=False)


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, folder))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, folder), with_kept=False)


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder))


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(documents(spark, folder), tokenizer_file("piece_bpe_32k.model"))


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    talk = spark.read.parquet(f"{folder}/conversations.parquet")
    return chat_format.chat_format(chat_format.with_lookups(talk), chat_format.LOOKUPS)


def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.html_text(spark.read.parquet(f"{folder}/pages.parquet"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(documents(spark, folder), tokenizer_file("byte_bpe_50k.json")).drop("ids")


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, folder))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.filter_audit(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(documents(spark, folder))


QUERIES = (
    op1_ngram_join, op2_exact_dedup, op3_sentencepiece, op4_suffix_dedup, op5_mixing, op6_chat_format, op7_html_text,
    op8_toxicity, op9_token_files, op10_fingerprints, op11_filter_audit, op12_decontamination, op13_merkle_manifest,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": ngram_join.SQL, "op2_exact_dedup": exact_dedup.SQL, "op11_filter_audit": filter_audit.SQL, "op12_decontamination": decontaminate.SQL,
        "op13_merkle_manifest": merkle.SQL,
    }
