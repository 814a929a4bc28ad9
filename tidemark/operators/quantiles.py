"""Exact order statistics per group, safe when one group holds most of the rows.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation
buffer.  That is right for groups that fit and wrong for a group that holds a
third of a large table.  Groups above ``max_group`` rows therefore go another
way: a mergeable sketch brackets each wanted rank, one counting pass finds how
many rows lie below the bracket, and only the values inside it are ranked.
The answer is exact either way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.common import col, finite
from tidemark.session import attach, settle

MAX_GROUP = 1_000_000
SKETCH_ACCURACY = 10_000
# The sketch is off by at most n / accuracy ranks; the bracket leaves three times that.
BRACKET = 3.0 / SKETCH_ACCURACY


def _largest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the largest group: one pre-aggregated count, one number back."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def grouped_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str | Column,
    probabilities: dict[str, float],
    count_as: str | None = None,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """``(keys, one column per probability[, count])``, linearly interpolated.

    Nulls and NaN are left out of the values; groups without values have no row.
    """
    rows = df.select(*keys, finite(value).alias("_v")).where(F.col("_v").isNotNull())
    count_as = count_as or "_n"
    keep = [*keys, *probabilities] + ([] if count_as == "_n" else [count_as])
    if _largest_group(rows, keys) <= max_group:
        return _direct(rows, keys, probabilities, count_as).select(*keep)
    sizes = settle(rows.groupBy(*keys).agg(F.count("*").alias(count_as)))
    large = sizes.where(F.col(count_as) > max_group)
    if keys:
        tagged = attach(rows, large.select(*keys, F.lit(True).alias("_large")), keys)
        small = tagged.where(F.col("_large").isNull()).drop("_large")
        big = tagged.where(F.col("_large").isNotNull()).drop("_large")
        return (
            _direct(small, keys, probabilities, count_as)
            .unionByName(_bracketed(big, keys, large, probabilities, count_as))
            .select(*keep)
        )
    return _bracketed(rows, keys, large, probabilities, count_as).select(*keep)


def _direct(rows: DataFrame, keys: list[str], probabilities: dict[str, float], count_as: str):
    wanted = F.array(*[F.lit(float(p)) for p in probabilities.values()])
    grouped = rows.groupBy(*keys).agg(
        F.percentile("_v", wanted).alias("_q"), F.count("*").alias(count_as)
    )
    return grouped.where(F.col(count_as) > 0).select(
        *keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probabilities)], count_as
    )


def _bracket_counts(rows: DataFrame, keys: list[str], probabilities: dict[str, float], bracket: float = BRACKET) -> DataFrame:
    """Running counts around each wanted rank: ``(keys, name, rank, position, _v, c, upto)``.

    The first row of each name has a null value and stands for all rows below
    the bracket.
    """
    names = list(probabilities)
    lows = [max(0.0, p - bracket) for p in probabilities.values()]
    highs = [min(1.0, p + bracket) for p in probabilities.values()]
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", [*lows, *highs], SKETCH_ACCURACY).alias("_s"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.count("*").alias("_n"),
    )
    k = len(names)
    # Below this size the bracket would span too few ranks; the whole group is ranked.
    wide = F.col("_n") > 2 * SKETCH_ACCURACY
    brackets = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                (F.col("_min") if lows[i] == 0.0 else F.when(wide, F.col("_s")[i]).otherwise(F.col("_min"))).alias("low"),
                (F.col("_max") if highs[i] == 1.0 else F.when(wide, F.col("_s")[k + i]).otherwise(F.col("_max"))).alias("high"),
                # Zero-based ranks on both sides of the wanted position.
                F.floor(F.lit(probabilities[name]) * (F.col("_n") - 1)).alias("rank"),
                (F.lit(probabilities[name]) * (F.col("_n") - 1)).alias("position"),
            )
            for i, name in enumerate(names)
        ]
    )
    plan = sketch.select(*keys, brackets.alias("_b"))
    # Rows below a bracket only add to a count, rows above it are dropped, and
    # equal values inside it collapse, all before the shuffle.
    if keys:
        placed = attach(rows, plan, keys, "inner")
    else:
        only = settle(plan).first()["_b"]  # one row: no keys
        literal = F.array(
            *[
                F.struct(
                    F.lit(b["name"]).alias("name"),
                    F.lit(b["low"]).alias("low"),
                    F.lit(b["high"]).alias("high"),
                    F.lit(b["rank"]).alias("rank"),
                    F.lit(b["position"]).alias("position"),
                )
                for b in only
            ]
        )
        placed = rows.withColumn("_b", literal)
    placed = (
        placed.select(*keys, "_v", F.explode("_b").alias("b"))
        .where(F.col("_v") <= F.col("b.high"))
        .select(
            *keys,
            F.col("b.name").alias("name"),
            F.col("b.rank").alias("rank"),
            F.col("b.position").alias("position"),
            F.when(F.col("_v") >= F.col("b.low"), F.col("_v")).alias("_v"),
        )
    )
    counted = placed.groupBy(*keys, "name", "rank", "position", "_v").agg(F.count("*").alias("c"))
    return _running(counted, [*keys, "name"], "_v")


def _running(counted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``upto``, the running count over distinct values, nulls first."""
    order = (
        Window.partitionBy(*keys)
        .orderBy(F.col(value).asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return counted.withColumn("upto", F.sum("c").over(order))


def _at(rank: Column) -> Column:
    """Value at a zero-based rank of a running count."""
    inside = (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)
    return F.max(F.when(inside, F.col("_v")))


def _bracketed(
    rows: DataFrame,
    keys: list[str],
    sizes: DataFrame,
    probabilities: dict[str, float],
    count_as: str,
) -> DataFrame:
    """Order statistics of large groups by sketch, count and rank.

    A bracket that missed its rank is widened until it holds it.
    """
    names, bracket = list(probabilities), BRACKET
    while True:
        ranked = _bracket_counts(rows, keys, probabilities, bracket)
        picked = settle(
            ranked.groupBy(*keys, "name", "rank", "position").agg(
                _at(F.col("rank")).alias("lower"), _at(F.col("rank") + 1).alias("upper")
            )
        )
        missed = F.col("lower").isNull() | (F.col("upper").isNull() & (F.col("position") > F.col("rank")))
        if bracket >= 1.0 or picked.where(missed).isEmpty():
            break
        bracket = min(1.0, 10 * bracket)
    share = F.col("position") - F.col("rank")
    result = picked.withColumn(
        "q",
        F.when(share == 0, F.col("lower")).otherwise(
            F.col("lower") + share * (F.col("upper") - F.col("lower"))
        ),
    )
    wide = result.groupBy(*keys).pivot("name", names).agg(F.first("q"))
    if keys:
        return attach(wide, sizes, keys, "inner")
    total = sizes.first()[count_as]
    return wide.withColumn(count_as, F.lit(total))


def grouped_middle(
    df: DataFrame, keys: list[str], value: str, max_group: int = MAX_GROUP
) -> DataFrame:
    """``(keys, _n, _lo, _mid, _hi)``: the middle value of each group and its neighbours.

    With an even count ``_lo`` and ``_hi`` are the two middle values.
    """
    rows = df.select(*keys, finite(value).alias("_v")).where(F.col("_v").isNotNull())
    sizes = settle(rows.groupBy(*keys).agg(F.count("*").alias("_n")))
    half = F.floor(F.col("_n") / 2)
    ranks = {"_lo": half - 1, "_mid": half, "_hi": F.when(F.col("_n") % 2 == 1, half + 1).otherwise(half)}

    def pick(ranked: DataFrame) -> DataFrame:
        joined = attach(ranked, sizes, keys, "inner")
        return joined.groupBy(*keys, "_n").agg(*[_at(rank).alias(name) for name, rank in ranks.items()])

    large = sizes.where(F.col("_n") > max_group)
    if not large.limit(1).count():
        counted = rows.groupBy(*keys, "_v").agg(F.count("*").alias("c"))
        return pick(_running(counted, keys, "_v"))
    tagged = attach(rows, large.select(*keys, F.lit(True).alias("_large")), keys)
    small = tagged.where(F.col("_large").isNull()).groupBy(*keys, "_v").agg(F.count("*").alias("c"))
    big = tagged.where(F.col("_large").isNotNull()).drop("_large")
    around = _bracket_counts(big, keys, {"middle": 0.5}).drop("name", "rank", "position")
    return pick(_running(small, keys, "_v")).unionByName(pick(around))


def grouped_median(
    df: DataFrame,
    keys: list[str],
    value: str | Column,
    name: str = "median",
    count_as: str = "n",
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """``(keys, median, n)``."""
    return grouped_quantiles(df, keys, value, {name: 0.5}, count_as, max_group)


def weighted_quantiles(
    df: DataFrame, keys: list[str], value: str, weight: str, probabilities: dict[str, float]
) -> DataFrame:
    """Quantiles of a table that already holds one row per distinct value."""
    wanted = F.array(*[F.lit(float(p)) for p in probabilities.values()])
    grouped = df.groupBy(*keys).agg(
        F.percentile(col(value).cast("double"), wanted, col(weight)).alias("_q")
    )
    return grouped.select(
        *keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probabilities)]
    )


def bucket_edges(edges: Sequence[float]) -> list[float]:
    """Distinct quantile edges in order, nulls left out."""
    return sorted({float(e) for e in edges if e is not None and not math.isnan(e)})


def right_closed_bucket(value: str | Column, edges: Sequence[Column | float]) -> Column:
    """1-based bucket with right-closed edges; the lowest edge is included."""
    value = col(value)
    inner = [e if isinstance(e, Column) else F.lit(float(e)) for e in edges]
    chain = F.when((value < inner[0]) | (value > inner[-1]), F.lit(None).cast("int"))
    for i, edge in enumerate(inner[1:], start=1):
        chain = chain.when(value <= edge, F.lit(i))
    return chain
