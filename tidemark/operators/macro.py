"""Dispersions, correlations and context figures of macro series.

Series are long tables ``(keys, role, date, value)``; one series of one market
is a bounded group, so ordered windows per series are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.errors import SchemaError
from tidemark.functions.common import finite
from tidemark.operators.quantiles import grouped_quantiles

# Channels, the series that informs each, its sign and scale.
CHANNEL_SERIES = (
    ("comps_drift", "home_price_index", 1.0, "absolute"),
    ("absorption", "median_days_on_market", -1.0, "absolute"),
    ("competing_listings", "active_listings", 1.0, "relative"),
)
# Fallback dispersions and correlation priors.
FALLBACK_SIGMA = {"comps_drift": 0.03, "absorption": 0.15, "competing_listings": 0.0}
FALLBACK_CORRELATION = {
    ("absorption", "competing_listings"): -0.40,
    ("absorption", "comps_drift"): 0.30,
}
PRICE_CORRELATION = {
    ("beta_price", "absorption"): 0.50,
    ("beta_price", "competing_listings"): -0.30,
    ("beta_price", "comps_drift"): 0.20,
}
YEAR_DAYS = 365.25


def _order(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("date")


def innovations(series: DataFrame, keys: list[str], kind: str = "log_return") -> DataFrame:
    """Step of each series over its finite values; gaps are closed first."""
    rows = series.withColumn("value", finite("value")).where(F.col("value").isNotNull())
    rows = rows.withColumn("_prev", F.lag("value").over(_order(keys)))
    if kind == "log_return":
        both = (F.col("value") > 0) & (F.col("_prev") > 0)
        step = F.when(both, F.log("value") - F.log("_prev"))
    elif kind == "diff":
        step = F.col("value") - F.col("_prev")
    else:
        raise SchemaError(f"unknown kind {kind!r}")
    return rows.withColumn("innovation", step).where(F.col("innovation").isNotNull()).drop("_prev")


def adjacent_innovations(series: DataFrame, keys: list[str]) -> DataFrame:
    """Log return between neighbouring raw rows; a gap breaks the pair."""
    rows = series.withColumn("value", finite("value"))
    rows = rows.withColumn("_prev", F.lag("value").over(_order(keys)))
    both = (F.col("value") > 0) & (F.col("_prev") > 0)
    return rows.where(both).withColumn("innovation", F.log("value") - F.log("_prev")).drop("_prev")


def periods_per_year(series: DataFrame, keys: list[str]) -> DataFrame:
    """Nominal frequency from the median spacing of the dates; 12 when too short."""
    gap = F.date_diff("date", F.lag("date").over(_order(keys)))
    gaps = series.where(F.col("date").isNotNull()).withColumn("_gap", gap)
    found = grouped_quantiles(gaps, keys, "_gap", {"spacing": 0.5}, "gaps")
    everyone = series.select(*keys).distinct()
    rate = F.least(F.greatest(F.round(YEAR_DAYS / F.col("spacing")), F.lit(1.0)), F.lit(365.0))
    usable = (F.col("gaps") >= 2) & (F.col("spacing") > 0)
    return everyone.join(found, keys, "left").select(
        *keys, F.when(usable, rate).otherwise(12.0).alias("periods_per_year")
    )


def dispersions(
    series: DataFrame, keys: list[str], horizon_days: float, kind: str = "log_return"
) -> DataFrame:
    """Deviation of the steps scaled to the horizon; zero when too short."""
    steps = innovations(series, keys, kind).groupBy(*keys).agg(
        F.stddev_samp("innovation").alias("sd"), F.count("*").alias("steps")
    )
    periods = F.col("periods_per_year") * (horizon_days / YEAR_DAYS)
    scaled = F.when(F.col("steps") >= 2, F.col("sd") * F.sqrt(F.greatest(periods, F.lit(0.0))))
    return (
        periods_per_year(series, keys)
        .join(steps, keys, "left")
        .select(*keys, F.coalesce(scaled, F.lit(0.0)).alias("sigma"))
    )


def aligned_innovations(
    series: DataFrame, market: list[str], roles: list[str], signs: dict[str, float] = {}
) -> DataFrame:
    """One row per market and date on which every role has a step, signs applied."""
    steps = adjacent_innovations(series.where(F.col("role").isin(*roles)), [*market, "role"])
    sign: Column = F.lit(1.0)
    for role, value in signs.items():
        sign = F.when(F.col("role") == role, F.lit(value)).otherwise(sign)
    steps = steps.withColumn("innovation", F.col("innovation") * sign)
    wide = steps.groupBy(*market, "date").pivot("role", roles).agg(F.first("innovation"))
    return wide.na.drop(subset=roles)


def correlations(aligned: DataFrame, market: list[str], roles: list[str], least: int = 3) -> DataFrame:
    """``(market, a, b, rho, n)`` of every pair on the common dates."""
    pairs = [(a, b) for i, a in enumerate(roles) for b in roles[i + 1 :]]
    table = aligned.groupBy(*market).agg(
        F.count("*").alias("n"), *[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    )
    long = F.inline(
        F.array(
            *[
                F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("rho"))
                for i, (a, b) in enumerate(pairs)
            ]
        )
    )
    found = table.where(F.col("n") >= least).select(*market, "n", long)
    rho = F.least(F.greatest("rho", F.lit(-1.0)), F.lit(1.0))
    known = F.col("rho").isNotNull() & ~F.isnan("rho")
    return found.where(known).withColumn("rho", rho)


def correlation_set(estimated: DataFrame, markets: DataFrame, market: list[str]) -> DataFrame:
    """Estimated pairs, missing pairs from the priors, price pairs always priors."""
    spark = estimated.sparkSession
    fixed = [(a, b, r, "prior", 2) for (a, b), r in FALLBACK_CORRELATION.items()]
    fixed += [(a, b, r, "fixed", 0) for (a, b), r in PRICE_CORRELATION.items()]
    priors = spark.createDataFrame(fixed, "a string, b string, rho double, source string, rank int")
    listed = markets.select(*market).distinct().withColumn(
        "_p", F.explode(F.array(*[F.struct(*[F.lit(x) for x in row]) for row in fixed]))
    )
    prior_rows = listed.select(*market, *[F.col(f"_p.col{i + 1}").alias(n) for i, n in enumerate(priors.columns)])
    # A pair may be stated in either order.
    both = estimated.select(
        *market, "a", "b", "rho", F.lit("data").alias("source"), F.lit(1).alias("rank")
    ).unionByName(prior_rows)
    pair = F.array_sort(F.array("a", "b"))
    best = both.groupBy(*market, pair.alias("pair")).agg(F.min(F.struct("rank", "a", "b", "rho", "source")).alias("x"))
    return best.select(*market, "x.a", "x.b", "x.rho", "x.source")


def from_last(series: DataFrame, keys: list[str], position: int, name: str) -> DataFrame:
    """The n-th finite value from the end, 1 being the last; null when too short."""
    rows = series.withColumn("value", finite("value")).where(F.col("value").isNotNull())
    back = Window.partitionBy(*keys).orderBy(F.desc("date"))
    return (
        rows.withColumn("_n", F.row_number().over(back))
        .where(F.col("_n") == position)
        .select(*keys, F.col("value").alias(name))
    )


def level_and_change(
    series: DataFrame, keys: list[str], back: int, log_change: bool = False, at_least: int | None = None
) -> DataFrame:
    """Last value and its change against the ``back``-th value from the end."""
    need = back if at_least is None else at_least
    rows = series.withColumn("value", finite("value")).where(F.col("value").isNotNull())
    order = Window.partitionBy(*keys).orderBy(F.desc("date"))
    rows = rows.withColumn("_n", F.row_number().over(order))
    table = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("_n") == 1, F.col("value"))).alias("latest"),
        F.max(F.when(F.col("_n") == back, F.col("value"))).alias("_then"),
    )
    if log_change:
        ok = (F.col("n") >= need) & (F.col("latest") > 0) & (F.col("_then") > 0)
        change = F.when(ok, F.log("latest") - F.log("_then"))
    else:
        change = F.when(F.col("n") >= need, F.col("latest") - F.col("_then"))
    return table.withColumn("change", change).drop("_then")


def yearly_log_change(series: DataFrame, keys: list[str], periods: int = 12) -> DataFrame:
    """Log change over one year of periods."""
    return level_and_change(series, keys, periods + 1, True).select(*keys, F.col("change").alias("yoy"))


def context(series: DataFrame, market: list[str]) -> DataFrame:
    """Appreciation (nominal, price level, real), rate and unemployment, per market."""
    def role(name: str) -> DataFrame:
        return series.where(F.col("role") == name)

    nominal = yearly_log_change(role("home_price_index"), market).withColumnRenamed("yoy", "appreciation_nominal")
    prices = yearly_log_change(role("area_cpi"), market).withColumnRenamed("yoy", "inflation")
    rate = level_and_change(role("mortgage_rate"), market, 52, at_least=53).select(
        *market, F.col("latest").alias("mortgage_rate"), F.col("change").alias("mortgage_rate_change"))
    jobless = level_and_change(role("unemployment_rate"), market, 12, at_least=13).select(
        *market, F.col("latest").alias("unemployment"), F.col("change").alias("unemployment_change"))
    table = series.select(*market).distinct()
    for part in (nominal, prices, rate, jobless):
        table = table.join(part, market, "left")
    return table.withColumn("appreciation_real", F.col("appreciation_nominal") - F.col("inflation"))


def missing_roles(series: DataFrame, market: list[str]) -> DataFrame:
    """Markets and the required roles they have no series for."""
    roles = F.explode(F.array(*[F.lit(role) for _, role, _, _ in CHANNEL_SERIES])).alias("role")
    wanted = series.select(*market).distinct().select(*market, roles)
    return wanted.join(series.select(*market, "role"), [*market, "role"], "left_anti")


def snapshot(
    series: DataFrame, market: list[str], horizon_days: float, baselines: DataFrame | None = None
) -> DataFrame:
    """``(market, channel, sigma, source)``; fallback values where a series is absent.

    A relative channel is scaled by the competing-listings level of the market.
    """
    sigma = dispersions(series, [*market, "role"], horizon_days)
    short = missing_roles(series, market).select(*market).distinct().withColumn("_short", F.lit(True))
    channels = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("channel"), F.lit(r).alias("role"), F.lit(s).alias("scale"),
                    F.lit(FALLBACK_SIGMA[c]).alias("fallback"),
                )
                for c, r, _, s in CHANNEL_SERIES
            ]
        )
    )
    grid = series.select(*market).distinct().select(*market, channels.alias("c")).select(*market, "c.*")
    table = grid.join(sigma, [*market, "role"], "left").join(short, market, "left")
    if baselines is not None:
        table = table.join(baselines, market, "left")
        level = F.coalesce("baseline", F.lit(30.0))
    else:
        level = F.lit(30.0)
    factor = F.when(F.col("scale") == "relative", level).otherwise(1.0)
    value = F.when(F.col("_short"), F.col("fallback")).otherwise(F.col("sigma"))
    return table.select(
        *market, "channel", (value * factor).alias("sigma"),
        F.when(F.col("_short"), "static_fallback").otherwise("series").alias("source"),
    )
