"""Delimited listing exports: every column a string, one row order per file."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.errors import SchemaError
from tidemark.functions.text import null_tokens
from tidemark.session import settle

SUFFIXES = (".csv", ".txt")
FILE = "_source_file"
ORDER = "_seq"
QUARTER = "_source_quarter"
BROKEN = "_broken_row"

# Fixed value: quarterly exports are named like "Q1-2023.csv" or "~Q3-2026.csv".
QUARTER_NAME = r"(?i)^~?\s*Q([1-4])[-_ ]?(\d{4})"


def export_files(spark: SparkSession, folder: str) -> list[str]:
    """All delimited files of a folder, by name.  Lists only; reads no content."""
    listing = spark.read.format("binaryFile").load(folder).select("path")
    paths = sorted(r.path for r in listing.collect() if r.path.lower().endswith(SUFFIXES))
    if not paths:
        raise SchemaError(f"no delimited files in {folder}")
    return paths


def quarter_of_file(name) -> F.Column:
    """``YYYYQn`` out of a file name, or null."""
    year = F.regexp_extract(name, QUARTER_NAME, 2)
    return F.when(year != "", F.concat(year, F.lit("Q"), F.regexp_extract(name, QUARTER_NAME, 1)))


def _reader(spark: SparkSession, multi_line: bool):
    return (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
    )


def file_heads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file, head, lines, broken)`` of every file, in one pass over their lines.

    ``broken`` counts the lines with an odd number of quotes: a value goes on in the next line.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("i"),
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # Ids of a task ascend with the lines it reads, so a block's least id is its first line.
    first = F.min(F.struct("block", "i", "value"))
    return lines.groupBy("file").agg(first["value"].alias("head"), F.count("*").alias("lines"), F.count(F.when(quotes % 2 == 1, 1)).alias("broken"))


def header_names(head: str) -> tuple[str, ...]:
    """Column names of a header line: blanks by their place, repeated names with it."""
    values = next(csv.reader([head]), [])
    lowered = [v.lower() for v in values]
    return tuple(f"_c{i}" if not v else f"{v}{i}" if lowered.count(v.lower()) > 1 else v for i, v in enumerate(values))


def read_exports(
    spark: SparkSession, paths: list[str] | str, multi_line: bool | None = None
) -> DataFrame:
    """Read one or more exports into one frame of strings.

    Files with the same header are read together; different headers are united
    by name.  Every row carries its file, the quarter the file name states, and
    an order that follows the file: ``(file, block start, row within block)``.

    One pass over all files finds their headers, and the files with line breaks inside quotes:
    those are read whole, the others split across tasks.  With ``multi_line`` false all are
    split and such rows show up in :func:`broken_rows`; with true all are read whole.
    Files without any line have no rows.
    """
    if isinstance(paths, str):
        paths = export_files(spark, paths) if not paths.lower().endswith(SUFFIXES) else [paths]
    for path in paths:
        if not path.lower().endswith(SUFFIXES):
            raise SchemaError(f"unsupported export type: {path}")
    groups: dict[tuple, list[str]] = {}
    for r in file_heads(spark, paths).orderBy("file").collect():  # a row per file
        whole = bool(r["broken"]) if multi_line is None else multi_line
        if r["head"].count('"') % 2:
            header = tuple(_reader(spark, True).csv(unquote(r["file"])).columns)
        else:
            header = header_names(r["head"])
        groups.setdefault((header, whole), []).append(unquote(r["file"]))

    result: DataFrame | None = None
    for (header, whole), members in groups.items():
        schema = T.StructType(
            [T.StructField(c, T.StringType()) for c in header] + [T.StructField(BROKEN, T.StringType())]
        )
        raw = (
            _reader(spark, whole)
            .schema(schema)
            .option("columnNameOfCorruptRecord", BROKEN)
            .csv(members)
        )
        frame = raw.select(
            *[null_tokens(F.col(f"`{c}`")).alias(c) for c in header],
            F.col(BROKEN),
            F.col("_metadata.file_path").alias(FILE),
            quarter_of_file(F.col("_metadata.file_name")).alias(QUARTER),
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias(ORDER),
        )
        result = frame if result is None else result.unionByName(frame, allowMissingColumns=True)
    return result


def broken_rows(df: DataFrame) -> DataFrame:
    """Rows the reader could not line up with the header, per file.

    The reader tells them only beside a column of the file, so both are written down first.
    """
    beside = next(c for c in df.columns if c not in (FILE, ORDER, QUARTER, BROKEN))
    judged = settle(df.select(FILE, BROKEN, f"`{beside}`"))
    return judged.where(F.col(BROKEN).isNotNull()).groupBy(FILE).agg(F.count("*").alias("rows"))


def rows_per_file(df: DataFrame, file_column: str = FILE) -> DataFrame:
    """Row count of every file."""
    return df.groupBy(file_column).agg(F.count("*").alias("rows"))
