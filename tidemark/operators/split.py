"""Exact held-out shares per class, by an order statistic of a row hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.common import col
from tidemark.session import settle

DIGIT = 15          # bits looked at a time
HASH_BITS = 60
SEAT_BITS = 62
FEW = 5_000         # rows of a bucket that are told apart on the driver


def row_hash(seed: int, keys: list[str]) -> Column:
    """60 bits out of a seed and row keys; written as text, so SQL can form the same."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def with_test_mark(df: DataFrame, label: str, share: float, keys: list[str], seed: int, name: str = "_test") -> DataFrame:
    """Add a mark that holds for exactly round(share x n) rows of every class of ``label``.

    The rows with the smallest hashes of their keys are marked.  Rows of equal hash are told
    apart by their seat in the written copy, so equal rows fall on both sides.  The smallest
    hash that is not marked is found digit by digit from counts: a class's histogram of
    the digit, then the one bucket that holds the border; no rows are sorted.
    """
    rows = settle(df.withColumn("_h", row_hash(seed, keys)).withColumn("_s", F.monotonically_increasing_id()))
    classes = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()
    borders = {r[label]: _border(rows.where(F.col(label) == r[label]), int(r["n"] * share + 0.5)) for r in classes}
    mark = F.lit(False)
    for value, (h, s) in borders.items():
        mark = mark | ((F.col(label) == F.lit(value)) & ((F.col("_h") < h) | ((F.col("_h") == h) & (F.col("_s") < s))))
    return rows.withColumn(name, F.coalesce(mark, F.lit(False))).drop("_h", "_s")


def _border(rows: DataFrame, k: int) -> tuple[int, int]:
    """(hash, seat) of the first of ``rows`` that is not among the k smallest."""
    for column, bits in (("_h", HASH_BITS), ("_s", SEAT_BITS)):
        low, shift = 0, bits
        while shift > 0:
            step = min(DIGIT, shift)
            shift -= step
            digit = F.shiftright(column, shift).bitwiseAND((1 << step) - 1)
            counts = sorted((r["d"], r["n"]) for r in rows.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect())
            at = None
            for d, n in counts:
                if k < n:
                    at = d
                    break
                k -= n
            if at is None:  # all rows are among them
                return 1 << 62, 0
            low |= at << shift
            rows = rows.where(digit == at)
            if n <= FEW:
                found = sorted((r["_h"], r["_s"]) for r in rows.select("_h", "_s").collect())
                return found[k]
        # All rows left have one value of this column; go on with the next.
    raise AssertionError("seats are distinct")
