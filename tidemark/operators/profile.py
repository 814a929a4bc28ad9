"""Counts and rates of a listing table: the ingest and feature reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.common import all_of, col, tally
from tidemark.functions.text import strip
from tidemark.operators.features import COVARIATES, MIN_CELL, cell_sizes
from tidemark.operators.quantiles import grouped_quantiles, weighted_quantiles
from tidemark.session import attach, beside
from tidemark.sources.headers import REQUIRED

# Warning thresholds.
COVERAGE_WARN = 0.05
IQR_NARROW = 0.03
IQR_WIDE = 0.35
THIN_SHARE = 0.20
BUILDING_MIN = 5
TOP_ZIPS = 10


def value_counts(df: DataFrame, column: str, keys: list[str] = []) -> DataFrame:
    """``(value, rows)``; null is a value."""
    return df.groupBy(*keys, F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows"))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(field, type, nulls, rate)`` of every column, in one pass."""
    types = dict(df.dtypes)
    counted = df.agg(
        F.count("*").alias("n"), *[tally(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(columns)]
    )
    rows = [
        F.struct(F.lit(c).alias("field"), F.lit(types[c]).alias("type"), F.col(f"c{i}").alias("nulls"))
        for i, c in enumerate(columns)
    ]
    long = counted.select("n", F.inline(F.array(*rows)))
    rate = F.round(F.try_divide(F.col("nulls"), F.col("n")), 4)
    return long.select("field", "type", "nulls", rate.alias("rate"))


def coverage(df: DataFrame, keys: list[str] = []) -> DataFrame:
    """Rows with and without a submarket, and whether the gap is too wide."""
    rate = F.try_divide(F.col("rows_without"), F.col("rows"))
    return (
        df.groupBy(*keys)
        .agg(
            F.count("*").alias("rows"),
            F.count("submarket").alias("rows_with"),
            tally(F.col("submarket").isNull()).alias("rows_without"),
        )
        .withColumns({"unmapped_rate": F.round(rate, 4), "coverage_gap": rate > COVERAGE_WARN})
    )


def top_unmapped(df: DataFrame, zip_column: str = "zip_code", k: int = TOP_ZIPS) -> DataFrame:
    """Most common codes without a submarket; ties by code."""
    lost = df.where(F.col("submarket").isNull() & F.col(zip_column).isNotNull())
    counts = lost.groupBy(zip_column).agg(F.count("*").alias("rows"))
    return counts.orderBy(F.desc("rows"), zip_column).limit(k)


def identification_counts(df: DataFrame, keys: list[str] = []) -> DataFrame:
    """Sold, censored, active, pending and event counts in one pass."""
    status = F.col("status")
    return df.groupBy(*keys).agg(
        tally(status == "SOLD").alias("sold"),
        (F.count("*") - tally(status == "SOLD")).alias("non_sold"),
        tally(status.isin("EXPIRED", "WITHDRAWN", "CANCELED")).alias("censored"),
        tally(status == "ACTIVE").alias("active"),
        tally(status == "PENDING").alias("pending"),
        tally(F.col("pending_treated_as_sold")).alias("pending_as_sold"),
        F.sum("event_sold").alias("events"),
        tally(
            all_of(F.col(c).isNotNull() for c in (*REQUIRED, "duration_days", "submarket"))
        ).alias("usable_rows"),
    )


def dense_cells(df: DataFrame, keys: list[str], least: int = MIN_CELL) -> DataFrame:
    """Number of cells with at least the minimum of rows."""
    return cell_sizes(df, keys).agg(tally(F.col("n") >= least).alias("dense_cells"), F.count("*").alias("cells"))


def building_support(df: DataFrame, building: str = "building_name", least: int = BUILDING_MIN) -> DataFrame:
    """How many buildings hold enough rows for a fixed effect.

    The median is taken over counts of counts, so it does not grow with the
    number of buildings.
    """
    name = F.nullif(strip(F.col(building).cast("string")), F.lit(""))
    counts = df.groupBy(name.alias("b")).agg(F.count("*").alias("n"))
    named = counts.where(F.col("b").isNotNull())
    sums = counts.agg(
        tally(F.col("b").isNotNull()).alias("buildings_named"),
        F.coalesce(F.sum(F.when(F.col("b").isNull(), F.col("n"))), F.lit(0)).alias("rows_missing_name"),
        tally(F.col("b").isNotNull() & (F.col("n") >= least)).alias("buildings_dense"),
        F.coalesce(
            F.sum(F.when(F.col("b").isNotNull() & (F.col("n") >= least), F.col("n"))), F.lit(0)
        ).alias("rows_in_dense"),
    )
    sizes = named.groupBy("n").agg(F.count("*").alias("c"))
    median = weighted_quantiles(sizes, [], "n", "c", {"median_rows": 0.5})
    return beside(sums, median)


PREMIUM_QUANTILES = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def premium_stats(
    df: DataFrame, premium: str = "rel_price_premium", event: str = "event_sold", keys: list[str] = []
) -> DataFrame:
    """Mean, deviation, quartile range, tails, and correlation with the event."""
    value = col(premium)
    rows = df.where(value.isNotNull() & ~F.isnan(value))
    both = F.col(event).isNotNull()
    varies = (
        (F.count(F.when(both, 1)) > 2)
        & (F.stddev_samp(F.when(both, value)) > 0)
        & (F.stddev_samp(F.col(event)) > 0)
    )
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.when(varies, F.corr(value, F.col(event).cast("double"))).alias("corr_event"),
    )
    quantiles = grouped_quantiles(df, keys, premium, PREMIUM_QUANTILES)
    if keys:
        joined = attach(sums, quantiles, keys, "inner")
    else:
        joined = beside(sums, quantiles)
    return joined.withColumn("iqr", F.col("p75") - F.col("p25")).drop("p25", "p75")


def covariate_gaps(df: DataFrame, columns: tuple[str, ...] = COVARIATES, keys: list[str] = []) -> DataFrame:
    """Null rate of each covariate and the complete rows."""
    present = [c for c in columns if c in df.columns]
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        tally(all_of(F.col(c).isNotNull() for c in present)).alias("complete_rows"),
        *[F.round(F.avg(F.col(c).isNull().cast("double")), 4).alias(f"null_{c}") for c in present],
    )


def feature_flags(df: DataFrame, keys: list[str] = []) -> DataFrame:
    """Rows whose features could not be computed for a stated reason."""
    basis = F.col("median_basis")
    return df.groupBy(*keys).agg(
        tally(F.col("is_penthouse") & F.col("log_floor").isNull()).alias("penthouses_without_floor"),
        tally(F.col("hoa_per_sqft_source") == "negative").alias("negative_fees"),
        tally(basis.isin("insufficient", "missing")).alias("rows_without_median"),
        F.count("*").alias("rows"),
    )


def feature_warnings(stats: DataFrame, flags: DataFrame, residual: bool) -> DataFrame:
    """Warnings the feature numbers call for; both inputs are one row."""
    row = beside(stats, flags)
    rules: list[tuple[Column, str]] = [
        (F.col("iqr") < IQR_NARROW, "pricing variation too narrow"),
        ((F.col("iqr") > IQR_WIDE) & F.lit(not residual), "pricing variation too wide"),
        (F.col("rows_without_median") / F.col("rows") > THIN_SHARE, "thin cells"),
        (F.col("negative_fees") > 0, "negative fees"),
        (F.col("corr_event") >= 0, "smoke signal failed: premium and sale are not negatively related"),
        (F.lit(residual), "identification variable respecified as a residual"),
    ]
    found = F.filter(F.array(*[F.when(rule, F.lit(text)) for rule, text in rules]), lambda x: x.isNotNull())
    return row.select(F.explode(found).alias("warning"))


def ingest_warnings(
    identification: DataFrame, covered: DataFrame, layouts: DataFrame, cleaned: DataFrame, recovered: DataFrame
) -> DataFrame:
    """Warnings of the ingest report, one per line."""
    def told(df: DataFrame, rule: Column, text: str) -> DataFrame:
        return df.where(rule).limit(1).select(F.lit(text).alias("warning"))

    mixed = layouts.where(F.col("mixed")).select(
        F.concat(F.lit("mixed date formats in "), F.col("field")).alias("warning")
    ).distinct()
    parts = [
        told(identification, F.col("censored") == 0, "elasticity not identifiable: only sold records"),
        told(covered, F.col("coverage_gap"), "submarket coverage gap"),
        told(cleaned, F.col("list_ppsf_implausible") > 0, "implausible price per square foot nulled"),
        told(recovered, F.col("recovered") > 0, "list dates recovered from days on market"),
    ]
    for part in parts:
        mixed = mixed.unionByName(part)
    return mixed


def fit_time_comps(df: DataFrame, keys: list[str] = [], reference: str = "cell_median_ppsf") -> DataFrame:
    """Median reference price per submarket at fit time."""
    rows = df.where(F.col("submarket").isNotNull())
    return grouped_quantiles(rows, [*keys, "submarket"], reference, {"median_ppsf": 0.5})
