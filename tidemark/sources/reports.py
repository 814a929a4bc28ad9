"""Writers for result tables, and the fingerprint that names a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.common import col


def write_table(df: DataFrame, folder: str, name: str, partition_by: list[str] | None = None) -> str:
    """One result table as parquet under ``folder/name``."""
    path = f"{folder.rstrip('/')}/{name}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """A set of result tables, one folder each (fit metadata, ingest report)."""
    return {name: write_table(df, folder, name) for name, df in tables.items()}


def write_report(df: DataFrame, folder: str, name: str) -> str:
    """One report table as JSON lines."""
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").json(path)
    return path


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def fingerprint(
    df: DataFrame, keys: list[str], event: str, price: str, replicates: int, seed: int, version: str
) -> DataFrame:
    """A hash per key over row count, event sum and price sum.

    Sums are taken as decimals, so the hash does not depend on row order.
    """
    grouped = df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.sum(col(event).cast("bigint")).alias("events"),
        F.sum(F.round(col(price), 4).cast("decimal(30,4)")).alias("total"),
    )
    text = F.concat_ws(
        "|",
        *[F.col(c).cast("string") for c in ("rows", "events", "total")],
        F.lit(str(replicates)),
        F.lit(str(seed)),
        F.lit(version),
    )
    return grouped.withColumn("fingerprint", F.sha2(text, 256))
