"""The unit x phase x level cube: premium, probability, revenue, discounting.

Units meet phases by their project key, levels come from an explode, and every
measure is a projection of that row: nothing is shuffled per cell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.errors import SchemaError
from tidemark.functions.common import col, tally
from tidemark.functions.dates import MONTH_DAYS, SECONDS_PER_DAY, month_key, quarter_key, season
from tidemark.functions.finance import discount_factor, relative_premium
from tidemark.functions.floors import floor_band
from tidemark.operators.ladder import LEVELS, explode_levels
from tidemark.session import attach

# Discounting, horizon, presale lead, integration grid.
DISCOUNT_RATE = 0.12
HORIZON_DAYS = 180
PRESALE_LEAD_MONTHS = 24
ARRIVAL_POINTS = 60


def _month_shift(moment: Column, months: Column) -> Column:
    seconds = months * F.lit(MONTH_DAYS * SECONDS_PER_DAY)
    zero = F.lit(0)
    return moment.cast("timestamp_ntz") + F.make_dt_interval(
        zero, zero, zero, seconds.cast("decimal(18,6)")
    )


def phase_rows(
    units: DataFrame, phases: DataFrame, comps: DataFrame, keys: list[str], drift: float = 0.0
) -> DataFrame:
    """Every unit as it would look listed in every phase of its project.

    ``phases`` carries ``project_start, phase_index, start_month`` and
    ``competing_listings``; ``comps`` carries ``submarket, median_ppsf``.
    """
    rows = attach(units, phases, keys, "inner")
    rows = attach(rows, comps.select("submarket", "median_ppsf"), ["submarket"])
    date = _month_shift(F.col("project_start"), F.col("start_month"))
    rows = rows.withColumn("list_date", date)
    return rows.withColumns(
        {
            "list_month": month_key("list_date"),
            "list_quarter": quarter_key("list_date"),
            "season": season("list_date"),
            "floor_bucket": floor_band("floor"),
            "inventory_competition": F.col("competing_listings").cast("double"),
            "cell_median_ppsf": F.col("median_ppsf") * F.pow(F.lit(1 + drift), F.col("start_month")),
        }
    )


def releasable(lead_months: float = PRESALE_LEAD_MONTHS) -> Column:
    """True when the phase opens on or after the start of presale."""
    sellable = _month_shift(F.col("completion_date"), F.lit(-float(lead_months)))
    return F.coalesce(F.col("list_date") >= sellable, F.lit(False))


def gate_slack_months(lead_months: float = PRESALE_LEAD_MONTHS) -> Column:
    """Months of delay a released unit can absorb."""
    sellable = _month_shift(F.col("completion_date"), F.lit(-float(lead_months)))
    seconds = F.timestamp_diff("SECOND", sellable, F.col("list_date"))
    return seconds / F.lit(SECONDS_PER_DAY * MONTH_DAYS)


def clamp_to_support(
    rows: DataFrame, support: dict[str, float], keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Narrow each band to the fitted premium range around the mean reference.

    A unit whose bands do not overlap is marked ``outside_fitted_support``.  When
    no unit of a project overlaps, the two references are not comparable and
    the clamp stands down for that project.  Returns the rows and one row per
    project: units, units without overlap, and whether it stood down.
    """
    unit = [*keys, "unit_id"]
    bands = (
        rows.groupBy(*unit)
        .agg(
            F.avg("cell_median_ppsf").alias("_ref"),
            F.first("band_floor").alias("_bf"),
            F.first("band_ceiling").alias("_bc"),
        )
        .withColumns(
            {
                "_low": F.greatest(F.col("_bf"), F.col("_ref") * (1 + support["p1"])),
                "_high": F.least(F.col("_bc"), F.col("_ref") * (1 + support["p99"])),
            }
        )
        .withColumn("_overlap", F.coalesce(F.col("_high") > F.col("_low"), F.lit(False)) & F.col("_ref").isNotNull())
        .withColumn("_unsupported", F.col("_ref").isNotNull() & ~F.col("_overlap"))
    )
    projects = bands.groupBy(*keys).agg(
        F.count("*").alias("units"),
        tally(F.col("_unsupported")).alias("unsupported"),
        F.every("_unsupported").alias("stood_down"),
    )
    bands = attach(bands.drop("_bf", "_bc"), projects.select(*keys, "stood_down"), keys)
    joined = attach(rows, bands.drop("_ref"), unit)
    active = ~F.col("stood_down") & F.col("_overlap")
    joined = joined.withColumns(
        {
            "clamp_floor": F.when(active, F.col("_low")),
            "clamp_ceiling": F.when(active, F.col("_high")),
            "exclusion": F.when(
                F.col("_unsupported") & ~F.col("stood_down"), "outside_fitted_support"
            ),
        }
    )
    return joined.drop("_low", "_high", "_overlap", "_unsupported", "stood_down"), projects


def arrival_factor(
    probability: Column, start_month, annual_rate: float, survival: Sequence[float], days: Sequence[float]
) -> Column:
    """Expected discount factor given a sale within the horizon.

    ``survival`` is the baseline at ``days`` from release.  A cell's whole curve
    is that baseline raised to the power its horizon probability implies.  The
    sum over grid steps is written out: one exponential per grid point, all
    inside generated code.
    """
    base = np.clip(np.asarray(survival, dtype="float64"), 1e-12, 1.0)
    logs = np.log(base)
    months = np.asarray(days, dtype="float64") / MONTH_DAYS
    deltas = (1 + annual_rate) ** (-(0.5 * (months[:-1] + months[1:])) / 12)
    release = discount_factor(start_month, annual_rate)
    if logs[-1] >= 0:
        return release
    power = F.log(F.greatest(1 - probability, F.lit(1e-12))) / float(logs[-1])
    power = F.greatest(power, F.lit(0.0))
    # sum (S_m - S_m+1) d_m, regrouped so that each S_m is evaluated once.
    weights = np.concatenate([[deltas[0]], np.diff(deltas), [-deltas[-1]]])
    total = F.lit(0.0)
    for log_s, w in zip(logs, weights):
        total = total + float(w) * (F.exp(power * float(log_s)) if log_s != 0 else F.lit(1.0))
    mass = F.greatest(1 - F.exp(power * float(logs[-1])), F.lit(1e-12))
    share = F.least(F.greatest(release * total / mass, F.lit(0.0)), F.lit(1.0))
    return F.when(probability <= 0, release).otherwise(share)


def arrival_grid(horizon: float, follow_up: float | None, points: int = ARRIVAL_POINTS) -> np.ndarray:
    """Grid of days from release, capped at the longest observed spell."""
    return np.linspace(0.0, min(horizon, follow_up) if follow_up else horizon, points)


def revenue_cube(
    rows: DataFrame,
    probability: Callable[[], Column],
    keys: list[str],
    levels: int = LEVELS,
    annual_rate: float = DISCOUNT_RATE,
    lead_months: float = PRESALE_LEAD_MONTHS,
    baseline: tuple[Sequence[float], Sequence[float]] | None = None,
    keep: list[str] = [],
) -> DataFrame:
    """One row per unit, phase and level with premium, probability and revenue.

    ``probability`` is built after ``rel_price_premium`` is in place.
    ``baseline`` is ``(survival, days)``; with it revenue is discounted to the
    expected sale date, without it to the release date.  Units with a cell that
    cannot be scored are marked ``unscorable``.
    """
    rows = rows.withColumns({"releasable": releasable(lead_months), "discount_factor": discount_factor("start_month", annual_rate)})
    cells = explode_levels(rows, levels)
    if "clamp_floor" in rows.columns:
        clamped = F.least(F.greatest("price_ppsf", "clamp_floor"), F.col("clamp_ceiling"))
        cells = cells.withColumn(
            "price_ppsf", F.when(F.col("clamp_floor").isNotNull(), clamped).otherwise(F.col("price_ppsf"))
        )
    cells = cells.withColumn("rel_price_premium", relative_premium("price_ppsf", "cell_median_ppsf"))
    cells = cells.withColumn("probability", probability())
    expected = F.col("price_ppsf") * F.col("living_area_sqft") * F.col("probability")
    cells = cells.withColumn("expected_usd", expected)
    factor = F.col("discount_factor")
    if baseline is not None:
        factor = arrival_factor(F.col("probability"), "start_month", annual_rate, *baseline)
    cells = cells.withColumns(
        {
            "release_discounted_usd": F.col("expected_usd") * F.col("discount_factor"),
            "discounted_usd": F.col("expected_usd") * factor,
        }
    )
    names = [
        *keys, "unit_id", "phase_index", "level_index", "price_ppsf", "living_area_sqft",
        "rel_price_premium", "probability", "expected_usd", "release_discounted_usd",
        "discounted_usd", "discount_factor", "releasable", *keep,
    ]
    if "exclusion" in rows.columns:
        names.append("exclusion")
    return cells.select(*dict.fromkeys(names))


def unscorable_units(cube: DataFrame, keys: list[str]) -> DataFrame:
    """Units with at least one cell that has no probability."""
    bad = cube.where(F.col("probability").isNull() | F.isnan("probability"))
    return bad.select(*keys, "unit_id").distinct().withColumn("exclusion", F.lit("unscorable"))


def scorable_cube(cube: DataFrame, keys: list[str]) -> DataFrame:
    """The cube without units that are excluded or cannot be scored throughout."""
    if "exclusion" in cube.columns:
        cube = cube.where(F.col("exclusion").isNull()).drop("exclusion")
    bad = unscorable_units(cube, keys).drop("exclusion")
    return cube.join(bad, [*keys, "unit_id"], "left_anti")


def cube_notes(
    cube: DataFrame, keys: list[str], horizon: float, follow_up: float | None, support: dict | None
) -> DataFrame:
    """Counts and totals per project that the notes of a cube rest on."""
    once = F.col("level_index") == 0
    table = cube.groupBy(*keys).agg(
        tally(once).alias("unit_phase_cells"),
        tally(once & ~F.col("releasable")).alias("gated_cells"),
        F.sum("release_discounted_usd").alias("release_total_usd"),
        F.sum("discounted_usd").alias("arrival_total_usd"),
    )
    return table.withColumns(
        {
            "arrival_vs_release": F.col("arrival_total_usd") / F.col("release_total_usd") - 1,
            "horizon_beyond_follow_up": F.lit(bool(follow_up and horizon > follow_up)),
            "support_unknown": F.lit(support is None),
        }
    )


def demand_curve(cube: DataFrame, unit_id: str, phase_index: int) -> DataFrame:
    """Price and probability of one unit in one phase, by level."""
    return (
        cube.where((F.col("unit_id") == unit_id) & (F.col("phase_index") == phase_index))
        .select("level_index", "price_ppsf", "rel_price_premium", "probability", "expected_usd")
        .orderBy("level_index")
    )


def best_cells(cube: DataFrame, keys: list[str]) -> DataFrame:
    """Best releasable cell per unit by discounted revenue.

    No rule couples units here, so the sum is an upper bound on any plan.  Ties
    go to the earlier phase and the lower level.
    """
    place = F.struct(
        F.col("discounted_usd"), (-F.col("phase_index")).alias("p"), (-F.col("level_index")).alias("l"),
        F.col("price_ppsf"), F.col("probability"),
    )
    best = cube.where(F.col("releasable")).groupBy(*keys, "unit_id").agg(F.max(place).alias("b"))
    return best.select(
        *keys, "unit_id", (-F.col("b.p")).alias("phase_index"), (-F.col("b.l")).alias("level_index"),
        F.col("b.price_ppsf").alias("price_ppsf"), F.col("b.probability").alias("probability"),
        F.col("b.discounted_usd").alias("discounted_usd"),
    )


def planted_probability(beta: float, base: float = 0.7) -> Callable[[], Column]:
    """A known demand curve, ``1 - exp(-base * exp(beta * premium))``."""
    return lambda: 1 - F.exp(-base * F.exp(beta * F.col("rel_price_premium")))


def floor_grid(units: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Position of each unit on its floor, its plan row, and the price range of its building.

    A floor of one building is a bounded group.  Units without building or floor
    have no position; those without building share a price range.
    """
    known = F.col("building").isNotNull() & F.col("floor").isNotNull()
    place = Window.partitionBy(*keys, "building", "floor").orderBy("unit_id")
    seats = units.select(*keys, "unit_id", "building", "floor")
    placed = seats.where(known).withColumn("position", F.row_number().over(place)).unionByName(
        seats.where(~known).withColumn("position", F.lit(None).cast("int"))
    )
    joined = placed.join(
        plan.select(*keys, "unit_id", "phase_index", "price_ppsf"), [*keys, "unit_id"], "left"
    )
    ranges = joined.groupBy(*keys, "building").agg(
        F.min("price_ppsf").alias("min_price"), F.max("price_ppsf").alias("max_price")
    )
    return attach(joined, ranges, [*keys, "building"])


def npv(flows: DataFrame, keys: list[str], amount: str, months: str, annual_rate: float) -> DataFrame:
    """Net present value per key."""
    if not -1 < annual_rate < 1:
        raise SchemaError("the annual rate is a decimal: 0.12 means 12 %")
    return flows.groupBy(*keys).agg(
        F.sum(col(amount) * discount_factor(months, annual_rate)).alias("npv_usd")
    )
