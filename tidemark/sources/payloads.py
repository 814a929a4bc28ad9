"""Time series out of landed service answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.common import finite

OBSERVATIONS = "observations array<struct<date: string, value: string>>"
PERIODS = (
    "status string, Results struct<series: array<struct<seriesID: string,"
    " data: array<struct<year: string, period: string, value: string>>>>>"
)

# The word for a successful answer, and where half-years are put.
SUCCESS = "REQUEST_SUCCEEDED"
HALF_YEAR_MONTH = {"S01": 1, "S02": 7}


def dated_observations(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """``(keys, date, value)`` of a payload of dated observations.

    A ``.`` or a blank value is a gap: the row stays, its value is null.
    """
    parsed = df.select(*keys, F.from_json(payload, OBSERVATIONS).alias("p"))
    rows = parsed.select(*keys, F.inline("p.observations"))
    return rows.select(
        *keys,
        F.col("date").try_cast("date").alias("date"),
        finite(F.col("value").try_cast("double")).alias("value"),
    )


def period_month(period) -> F.Column:
    """Month number of a period code; null for annual averages and unknown codes."""
    period = F.col(period) if isinstance(period, str) else period
    month = F.regexp_extract(period, r"^M(\d{2})$", 1).try_cast("int")
    half = F.when(period == "S01", HALF_YEAR_MONTH["S01"]).when(
        period.startswith("S"), HALF_YEAR_MONTH["S02"]
    )
    return F.when(month.between(1, 12), month).otherwise(half)


def period_observations(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """``(keys, series_id, date, value)`` of a payload coded by year and period."""
    parsed = df.select(*keys, F.from_json(payload, PERIODS).alias("p"))
    series = parsed.where(F.col("p.status") == SUCCESS).select(*keys, F.inline("p.Results.series"))
    rows = series.select(*keys, F.col("seriesID").alias("series_id"), F.inline("data"))
    month = period_month("period")
    return rows.where(month.isNotNull()).select(
        *keys,
        "series_id",
        F.make_date(F.col("year").cast("int"), month, F.lit(1)).alias("date"),
        finite(F.col("value").try_cast("double")).alias("value"),
    )
