"""Helpers shared by the operators: arrow text as bytes, 64-bit mixing, sizes of a job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# White space of every contract: space and the five control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

U64 = np.uint64
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shuffle_width(spark: SparkSession) -> int:
    """The session's own number of shuffle partitions; buckets of packed rows follow it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


TASK_ROWS = 20_000


def tasks_for(rows: int) -> int:
    """Tasks for a table of small rows that are known to be about this many."""
    return max(1, -(-rows // TASK_ROWS))


def even_labels(spark: SparkSession, buckets: int) -> np.ndarray:
    """Numbers for buckets that a hash shuffle spreads evenly over the session's partitions.

    Buckets 0, 1, … would fall into partitions at random, several into some; of consecutive
    integers those are taken that fill the partitions in turn.
    """
    width, found = shuffle_width(spark), {}
    number = F.col("id").cast("int")
    each, tried = -(-buckets // width), 0
    while sum(min(len(v), each) for v in found.values()) < each * width:
        rows = spark.range(tried, tried + 8 * max(buckets, width)).select(number.alias("n"), F.pmod(F.hash(number), F.lit(width)).alias("p")).collect()
        for r in rows:
            found.setdefault(r["p"], []).append(r["n"])
        tried += 8 * max(buckets, width)
    return np.array([found[p][i] for i in range(each) for p in range(width)][:buckets], np.int32)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words with good avalanche."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n pseudorandom 64-bit words that depend on the seed alone."""
    start = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    return mix64(start + mix64(np.array([seed], dtype=U64)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1]
    places = places.astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 … base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)
