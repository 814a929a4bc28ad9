"""Price ladders: the band of each unit and its evenly spaced levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.errors import SchemaError
from tidemark.functions.common import col, finite, first_match
from tidemark.operators.design import Design

# Levels, margin over cost, narrowest band in dollars.
LEVELS = 15
MARGIN = 0.15
MIN_BAND = 1.0
TIME_CONTROLS = ("list_quarter", "list_month", "list_year")


def pinned_time_controls(design: Design, as_of: str | None = None) -> dict[str, Column]:
    """Literal columns that hold every time control at one fitted period.

    The latest period by default; a period the fit never saw is an error.
    """
    pinned: dict[str, Column] = {}
    for name in TIME_CONTROLS:
        if name not in design.categories:
            continue
        category = design.categories[name]
        levels = [category.reference, *category.levels]
        chosen = max(levels) if as_of is None else str(as_of)
        if chosen not in levels:
            raise SchemaError(f"{chosen!r} is not a period the surface was fitted on")
        pinned[name] = F.lit(chosen)
    return pinned


def price_bands(units: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Add the band of each unit, the source of its floor, and why it has none.

    Reads ``predicted_ppsf, p_floor_ppsf, p_ceiling_ppsf`` of a fitted surface
    and ``cost_basis_ppsf``.
    """
    if margin < 0:
        raise SchemaError("the margin must not be negative")
    units = units.withColumns(
        {
            "_comps_floor": finite("p_floor_ppsf"),
            "_cost_floor": finite("cost_basis_ppsf") * (1 + margin),
            "band_ceiling": finite("p_ceiling_ppsf"),
        }
    )
    no_comps = (
        finite("predicted_ppsf").isNull() | F.col("_comps_floor").isNull() | F.col("band_ceiling").isNull()
    )
    floor = F.greatest("_comps_floor", "_cost_floor")
    return units.withColumns(
        {
            "band_floor": floor,
            "floor_source": F.when(F.col("_cost_floor") >= F.col("_comps_floor"), "cost_basis").otherwise(
                "hedonic_comps"
            ),
            "exclusion": first_match(
                [
                    (no_comps, F.lit("no_comps")),
                    (F.col("_cost_floor").isNull(), F.lit("no_cost_basis")),
                    (F.col("band_ceiling") - floor < MIN_BAND, F.lit("cost_exceeds_comps")),
                ]
            ),
        }
    ).drop("_comps_floor", "_cost_floor")


def check_bounds(units: DataFrame, floor: str, ceiling: str) -> DataFrame:
    """Bands given from outside; every ceiling must exceed its floor."""
    bad = units.where(~(F.col(ceiling) > F.col(floor)) | F.col(floor).isNull() | F.col(ceiling).isNull())
    if bad.limit(1).count():
        raise SchemaError("every ceiling must exceed its floor")
    return units.withColumns(
        {
            "band_floor": F.col(floor),
            "band_ceiling": F.col(ceiling),
            "predicted_ppsf": (F.col(floor) + F.col(ceiling)) / 2,
            "floor_source": F.lit("hedonic_comps"),
            "exclusion": F.lit(None).cast("string"),
        }
    )


def level_price(floor, ceiling, level, levels: int) -> Column:
    """Price of a level; the last one is the ceiling itself."""
    floor, ceiling, level = col(floor), col(ceiling), col(level)
    step = (ceiling - floor) / (levels - 1)
    return F.when(level == levels - 1, ceiling).otherwise(floor + level * step)


def explode_levels(bands: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per unit and level with ``level_index`` and ``price_ppsf``."""
    if levels < 2:
        raise SchemaError("a ladder needs at least two levels")
    rows = bands.withColumn(
        "level_index", F.explode(F.array(*[F.lit(i) for i in range(levels)]))
    )
    return rows.withColumn("price_ppsf", level_price("band_floor", "band_ceiling", "level_index", levels))


def price_ladder(
    units: DataFrame, keys: list[str], levels: int = LEVELS, margin: float = MARGIN
) -> tuple[DataFrame, DataFrame]:
    """The long ladder ``(keys, unit_id, level_index, price_ppsf, …)`` and the excluded units."""
    bands = price_bands(units, margin)
    excluded = bands.where(F.col("exclusion").isNotNull()).select(*keys, "unit_id", "exclusion")
    kept = bands.where(F.col("exclusion").isNull()).drop("exclusion")
    return explode_levels(kept, levels), excluded


def nearest_levels(ladder: DataFrame, keys: list[str]) -> DataFrame:
    """Level nearest the predicted price per unit, the lowest when two tie."""
    gap = F.abs(F.col("price_ppsf") - F.col("predicted_ppsf"))
    return ladder.groupBy(*keys, "unit_id").agg(
        F.min(F.struct(gap.alias("gap"), F.col("level_index"))).alias("b")
    ).select(*keys, "unit_id", F.col("b.level_index").alias("level_index"))


def unmatched_units(ladder: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Ladder units the inventory does not have."""
    names = [*keys, "unit_id"]
    return ladder.select(*names).distinct().join(units.select(*names), names, "left_anti")


def uncovered_submarkets(units: DataFrame, comps: DataFrame) -> DataFrame:
    """Submarkets of the inventory without a comparable median."""
    return units.select("submarket").distinct().join(comps.select("submarket"), "submarket", "left_anti")
