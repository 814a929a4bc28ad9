"""Exact duplicates with the frequent digests split off.

Misra-Gries counters find, in one pass, every digest that holds more than a fixed share of
the rows.  The candidates are counted exactly; these winners, a table of bounded length, are
broadcast and their rows are settled where they lie, with no shuffle.  All other digests are
rarer than the share and go through an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import SPACE, text_or_empty
from tidemark.session import land, settle

COUNTERS = 1024


def misra_gries(values, counters: dict, most: int) -> None:
    """Count ``values`` into at most ``most`` counters; each falls short by at most n / (most + 1)."""
    for v in values:
        if v in counters:
            counters[v] += 1
        elif len(counters) < most:
            counters[v] = 1
        else:
            for k in [k for k, c in counters.items() if c == 1]:
                del counters[k]
            for k in counters:
                counters[k] -= 1


def _counters(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        seen = 0
        for batch in batches:
            seen += batch.num_rows
            misra_gries(batch.column(0).to_pylist(), found, most)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*found, None], pa.binary()), pa.array([*found.values(), seen], pa.int64())], names=["digest", "low"]
        )

    return run


def frequent_digests(rows: DataFrame, most: int = COUNTERS) -> DataFrame:
    """Digests that may hold 2 / (most + 1) of the rows or more; at most ``most`` + 1 of them.

    The counters of all tasks are added per digest.  What a task's counters fall short by adds
    up to rows / (most + 1), so every digest above twice that keeps more than once that, and
    the counters add up to no more than the rows.
    """
    low = settle(rows.select("digest").mapInArrow(_counters(most), "digest binary, low long").groupBy("digest").agg(F.sum("low").alias("low")))
    total = low.filter("digest is null").agg(F.coalesce(F.sum("low"), F.lit(0))).first()[0]
    return low.filter(F.col("digest").isNotNull() & (F.col("low") > F.lit(total / (most + 1)))).select("digest")


def digest_of(text_col: str) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text_col), SPACE, " ").cast("binary"), 256))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = COUNTERS) -> DataFrame:
    """Which row of each group of equal texts stays: the one with the smallest id.

    Texts are equal when identical after every run of ASCII white space is made one space; a
    null text counts as empty, so null, '' and '' are one group, and ' ' another.  Returns one
    row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Rows with a null id never win over rows with one; a group of null ids only keeps null.
    Rows that repeat the winner's id are all counted and all marked as kept.  An empty table
    gives an empty result.  Other columns are not read.
    """
    rows = land(df.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(text_col).alias("digest")), "digests")
    group = [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    heavy = frequent_digests(rows, most)
    winners = settle(rows.join(F.broadcast(heavy), "digest").groupBy("digest").agg(*group))
    # ``winners`` has a row per frequent digest, so the table that travels is bounded by ``most``.
    split = rows.join(F.broadcast(winners), "digest", "left")
    light = split.filter("group_size is null").select("doc_id", "digest")
    rest = light.join(light.groupBy("digest").agg(*group), "digest")
    columns = ["doc_id", "keep_id", "group_size", "digest"]
    return split.filter("group_size is not null").select(columns).union(rest.select(columns)).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = COUNTERS) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; one row for each kept id and text."""
    stay = settle(
        exact_dedup(df, id_col, text_col, most).filter("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("doc_id").alias("__stay"), F.unhex("text_sha256").alias("__digest"), "n")
    )
    own = df.withColumns({"__id": F.col(id_col).cast("long"), "__text": digest_of(text_col)})
    kept = own.join(stay, own["__id"].eqNullSafe(stay["__stay"]) & (own["__text"] == stay["__digest"]), "left_semi")
    # Rows that repeat id and text differ at most in columns that do not count; any of them will do.
    once = kept.dropDuplicates(["__id", "__text"]) if stay.filter("n > 1").limit(1).count() else kept
    return once.drop("__id", "__text")


SQL = r"""
WITH rows AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM rows WINDOW g AS (PARTITION BY text_sha256)
"""
