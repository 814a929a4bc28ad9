"""A corpus pipeline over ``documents``: the stages, in order, and their composition.

Toxic documents go, of equal texts one stays, of each group of near copies one stays, the
sources are mixed to their target weights, and the mix is encoded.  Every stage but the last
returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, mixing, ngram_join, pieces, toxicity
from tidemark.llm.common import tokenizer_file
from tidemark.session import land


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject; labels only teach the lexicon.

    Every row is judged by its own text: null texts stay, repeated rows and null ids are rows
    like others.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id; of rows equal in id and text one.

    A null text counts as empty; a null id stays only where no other row has the text.
    """
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest id.

    Several texts under one id are documents of their own; a null id counts as the largest.
    Null and blank texts are linked with nothing and stay.
    """
    return ngram_join.keep_first(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the words that each document gives, a row for each time it is used.

    Documents without words are not in a mix; null sources are a source of their own, null ids
    and several texts under one id are rows like others.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of the mix, a row for each of its rows; a null text has no pieces."""
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

# Learned weights and sampled segmentations cannot be written as SQL; tests hold every stage
# against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each stage's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
