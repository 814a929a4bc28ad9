"""Given plans: rollups, feasibility, extrapolation, crowding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.errors import SchemaError
from tidemark.functions.common import any_of, col, first_match, tally
from tidemark.functions.floors import floor_band
from tidemark.session import attach

# A floor missed by a cent is met; crowding and caveat limits.
CENT = 0.01
CROWDING = 0.30
MIN_FACTOR = 0.10
CEILING_ALARM = 0.50


def plan_cells(plan: DataFrame, cube: DataFrame, keys: list[str]) -> DataFrame:
    """Plan rows with the measures of their cell; rows outside the cube have nulls."""
    return plan.join(cube, [*keys, "unit_id", "phase_index", "level_index"], "left").withColumn(
        "total_price_usd", F.col("price_ppsf") * F.col("living_area_sqft")
    )


def comparable_group(unit_type="unit_type", floor="floor", unit_id="unit_id") -> Column:
    """Unit type and floor band; a unit with no usable floor is alone."""
    band = floor_band(floor)
    return F.concat_ws(
        "|", F.coalesce(col(unit_type), F.lit("unknown")),
        F.coalesce(band, F.concat(F.lit("floor_unknown:"), col(unit_id))),
    )


def phase_rollup(
    rows: DataFrame, phases: DataFrame, keys: list[str], basis: str = "nominal",
    expected: str = "expected_usd", discounted: str = "discounted_usd",
) -> DataFrame:
    """Units, revenue, mean price and floor test of every phase, empty ones too."""
    names = [*keys, "phase_index"]
    sums = rows.groupBy(*names).agg(
        F.count("*").alias("units_released"),
        F.sum(expected).alias("expected_usd"),
        F.sum(discounted).alias("discounted_usd"),
        F.avg("price_ppsf").alias("mean_price_ppsf"),
    )
    table = phases.select(*names, "start_month", "cash_flow_floor_usd").join(sums, names, "left")
    zero = F.lit(0.0)
    table = table.withColumns(
        {
            "units_released": F.coalesce("units_released", F.lit(0)),
            "expected_usd": F.coalesce("expected_usd", zero),
            "discounted_usd": F.coalesce("discounted_usd", zero),
        }
    )
    measured = F.col("discounted_usd" if basis == "discounted" else "expected_usd")
    floor = F.coalesce(F.col("cash_flow_floor_usd").cast("double"), zero)
    return table.withColumn("floor_met", measured >= floor - CENT)


def plan_totals(rows: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """Asking value, expected value, probability mass left out, share at the ceiling."""
    ask, p = F.col("total_price_usd"), F.col("probability")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("units_released"),
        F.sum(ask).alias("gross_ask_usd"),
        F.sum("expected_usd").alias("expected_usd"),
        F.sum("discounted_usd").alias("discounted_usd"),
        F.sum(1 - p).alias("unmodelled_mass"),
        F.sum(ask * (1 - p)).alias("unmodelled_usd"),
        F.avg((F.col("level_index") == levels - 1).cast("double")).alias("ceiling_share"),
    )


def plan_caveats(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Caveats that the totals of a plan call for."""
    rules = [
        (F.col("unmodelled_mass") > 0, "expected revenue is a partial sum: unsold mass is not carried on"),
        (F.col("ceiling_share") >= CEILING_ALARM, "half or more of the units sit at their price ceiling"),
    ]
    found = F.array(*[F.when(rule, F.lit(text)) for rule, text in rules])
    return totals.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("caveat"))


def unreleased_units(units: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Units no plan row releases."""
    names = [*keys, "unit_id"]
    return units.select(*names).join(plan.select(*names), names, "left_anti")


def level_histogram(rows: DataFrame, keys: list[str] = []) -> DataFrame:
    """Plan rows per ladder level."""
    return rows.groupBy(*keys, "level_index").agg(F.count("*").alias("rows"))


def extrapolation(rows: DataFrame, support: dict[str, float]) -> Column:
    """``outside``, ``tail`` or ``inside`` the fitted premium range."""
    premium = F.col("rel_price_premium")
    return first_match(
        [
            ((premium < support["low"]) | (premium > support["high"]), F.lit("outside")),
            ((premium < support["p1"]) | (premium > support["p99"]), F.lit("tail")),
            (premium.isNotNull(), F.lit("inside")),
        ]
    )


def extrapolation_report(
    rows: DataFrame, support: dict[str, float], keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Counts per project, and the rows outside or in a tail (a table, not a list)."""
    marked = rows.withColumn("support_zone", extrapolation(rows, support))
    counts = marked.groupBy(*keys).agg(
        tally(F.col("support_zone") == "outside").alias("outside"),
        tally(F.col("support_zone") == "tail").alias("tail"),
        F.min("rel_price_premium").alias("min_premium"),
        F.max("rel_price_premium").alias("max_premium"),
    )
    flagged = marked.where(F.col("support_zone").isin("outside", "tail"))
    return counts, flagged.select(*keys, "unit_id", "rel_price_premium", "support_zone")


def monotone_violations(rows: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Phases of a group that price below an earlier phase of the same group.

    Rows shrink to one per group and phase before the window sees them.
    """
    cells = rows.groupBy(*keys, group, "phase_index").agg(
        F.min("level_index").alias("low"), F.max("level_index").alias("high")
    )
    before = (
        Window.partitionBy(*keys, group)
        .orderBy("phase_index")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return cells.withColumn("earlier_high", F.max("high").over(before)).where(
        F.col("low") < F.col("earlier_high")
    )


def plan_violations(
    rows: DataFrame, phases: DataFrame, keys: list[str], basis: str = "nominal"
) -> DataFrame:
    """``(keys, rule, subject, measured, bound)`` of every broken rule of a plan.

    ``rows`` are plan cells with ``unit_type`` and ``comparable_group``;
    ``phases`` carries ``max_units`` and the map ``min_type_counts``.
    """
    names = [*keys, "phase_index"]

    def shape(df: DataFrame, rule: str, subject: Column, measured: Column, bound: Column) -> DataFrame:
        return df.select(
            *keys, F.lit(rule).alias("rule"), subject.cast("string").alias("subject"),
            measured.cast("double").alias("measured"), bound.cast("double").alias("bound"),
        )

    repeats = rows.groupBy(*keys, "unit_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    rollup = phase_rollup(rows, phases, keys, basis).join(
        phases.select(*names, "max_units", "min_type_counts"), names
    )
    measured = F.col("discounted_usd" if basis == "discounted" else "expected_usd")
    over = rollup.where(F.col("units_released") > F.col("max_units"))
    short = rollup.where((F.col("cash_flow_floor_usd") > 0) & ~F.col("floor_met"))
    gated = rows.where(~F.col("releasable"))
    needs = rollup.where(F.col("units_released") > 0).select(
        *names, F.explode("min_type_counts").alias("unit_type", "least")
    )
    have = rows.groupBy(*names, "unit_type").agg(F.count("*").alias("n"))
    lacking = (
        needs.join(have, [*names, "unit_type"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .where(F.col("n") < F.col("least"))
    )
    falling = monotone_violations(rows, keys, "comparable_group")
    phase = F.col("phase_index")
    parts = [
        shape(repeats, "at_most_once", F.col("unit_id"), F.col("n"), F.lit(1)),
        shape(over, "max_units", phase, F.col("units_released"), F.col("max_units")),
        shape(short, "cash_flow_floor", phase, measured, F.col("cash_flow_floor_usd")),
        shape(gated, "construction_gate", F.concat_ws("@", "unit_id", "phase_index"), F.lit(0), F.lit(1)),
        shape(lacking, "min_type_count", F.concat_ws("@", "unit_type", "phase_index"), F.col("n"), F.col("least")),
        shape(falling, "monotone_path", F.concat_ws("@", "comparable_group", "phase_index"), F.col("low"), F.col("earlier_high")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def crowding_factor(released, pool, severity: float = CROWDING) -> Column:
    """``max(0.1, 1 - severity * released / pool)``."""
    if not 0 <= severity <= 1:
        raise SchemaError("severity must lie in [0, 1]")
    return F.greatest(F.lit(MIN_FACTOR), 1 - severity * col(released) / col(pool))


def crowded_plan(
    rows: DataFrame, pools: DataFrame, keys: list[str], group: str = "comparable_group",
    severity: float = CROWDING,
) -> tuple[DataFrame, DataFrame]:
    """Plan rows scaled for units competing in one phase and group, and the clusters.

    ``pools`` is ``(keys, phase_index, buyer_pool)``.
    """
    names = [*keys, "phase_index", group]
    clusters = rows.groupBy(*names).agg(
        F.count("*").alias("units_released"), F.sum("expected_usd").alias("uncorrected_usd")
    )
    clusters = attach(clusters, pools, [*keys, "phase_index"]).withColumn(
        "factor", crowding_factor("units_released", "buyer_pool", severity)
    )
    clusters = clusters.withColumns(
        {
            "corrected_usd": F.col("uncorrected_usd") * F.col("factor"),
            "removed_usd": F.col("uncorrected_usd") * (1 - F.col("factor")),
        }
    )
    joined = attach(rows, clusters.select(*names, "factor"), names)
    scaled = joined.withColumns(
        {c: F.col(c) * F.col("factor") for c in ("probability", "expected_usd", "discounted_usd")}
    )
    return scaled, clusters


def worst_cluster(clusters: DataFrame, keys: list[str], group: str = "comparable_group") -> DataFrame:
    """The cluster that loses most, per project; none where nothing is crowded."""
    best = F.max(F.struct(F.col("removed_usd"), (-F.col("phase_index")).alias("p"), F.col(group), F.col("factor")))
    return (
        clusters.where(F.col("factor") < 1)
        .groupBy(*keys)
        .agg(best.alias("w"))
        .select(*keys, F.col(f"w.{group}").alias(group), (-F.col("w.p")).alias("phase_index"),
                F.col("w.removed_usd").alias("removed_usd"), F.col("w.factor").alias("factor"))
    )


def crowding_totals(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Uncorrected and corrected revenue and the share removed."""
    table = clusters.groupBy(*keys).agg(
        F.sum("uncorrected_usd").alias("uncorrected_usd"), F.sum("corrected_usd").alias("corrected_usd")
    )
    share = 1 - F.try_divide("corrected_usd", "uncorrected_usd")
    return table.withColumn("share_removed", F.coalesce(share, F.lit(0.0)))


def enrich(rows: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Plan rows with the descriptive columns of their unit."""
    names = [*keys, "unit_id"]
    extra = [c for c in ("unit_type", "floor", "view", "building", "submarket") if c in units.columns and c not in rows.columns]
    return rows.join(units.select(*names, *extra), names, "left")


def search(rows: DataFrame, text: str, columns: list[str], sort: str, ascending: bool = True) -> DataFrame:
    """Rows whose columns contain the text, in the order of one column."""
    needle = text.strip().lower()
    if needle:
        rows = rows.where(any_of(F.lower(F.col(c).cast("string")).contains(needle) for c in columns))
    return rows.orderBy(F.col(sort).asc() if ascending else F.col(sort).desc())


def objective_difference(rows: DataFrame, cube: DataFrame, reported: DataFrame, keys: list[str]) -> DataFrame:
    """Recompute the objective of a plan from its cube and compare with a reported one."""
    again = plan_cells(rows, cube, keys).groupBy(*keys).agg(F.sum("discounted_usd").alias("recomputed_usd"))
    return reported.join(again, keys, "left").withColumn(
        "difference_usd", F.col("recomputed_usd") - F.col("objective_usd")
    )
