"""Proportional hazards over a listing table, whole or in strata.

Rows lie sorted by (stratum, day) in partitions of bounded size, and a Newton step is a few
passes that return some numbers a partition (``operators/hazard.py``), so neither the number of
distinct days nor that of strata is bounded.  With strata every level has a baseline of its own
and the covariates are compared within it; no column per level is made.

Ties follow Efron's approximation, the baseline hazard Breslow's estimator.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.errors import SchemaError
from tidemark.functions.common import col
from tidemark.functions.finance import relative_premium
from tidemark.operators.design import Design, learn_design, linear_predictor
from tidemark.operators.fits import Fit
from tidemark.operators.hazard import Passes, Recipe, lay_out, maximise
from tidemark.operators.quantiles import grouped_quantiles
from tidemark.session import attach, settle

DURATION, EVENT, PRICE = "duration_days", "event_sold", "rel_price_premium"

BUILDING = "building_name"
POOLED_ALARM = 0.50
THIN_LEVEL_ROWS = 40.0
HELD_CELLS = 50_000   # cells of a baseline up to which the driver keeps a copy for look-ups
POINTS_AT_ONCE = 40


@dataclass
class CoxFit:
    """A fitted hazard model and its baseline.

    ``cells`` has a row per (stratum, day): ``t``, ``events``, ``risk``, ``hazard``,
    ``cumulative``, and the level under ``strata``'s name where the fit has strata.
    """

    fit: Fit
    cells: DataFrame
    max_duration: float
    support: dict[str, float] | None
    means: np.ndarray
    strata: str | None = None
    held: tuple[np.ndarray, np.ndarray] | None = None

    def _known(self, days) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per asked day: the cells around it, as (day, cumulative) before and behind."""
        if self.strata is not None:
            raise SchemaError("a fit with strata has a baseline per level; use cumulative_per_stratum")
        days = np.atleast_1d(np.asarray(days, dtype="float64"))
        if self.held is not None:
            grid, total = (np.concatenate([[0.0], v]) for v in self.held)
            at = np.searchsorted(grid, days, side="right") - 1
            low, high = np.maximum(at, 0), np.minimum(at + 1, len(grid) - 1)
            return grid[low], total[low], grid[high], total[high]
        out = []
        for lo in range(0, len(days), POINTS_AT_ONCE):
            some = days[lo : lo + POINTS_AT_ONCE]
            row = self.cells.agg(*[c.alias(f"c{i}") for i, c in enumerate(c for d in some for c in _around(F.lit(float(d))))]).first()
            out += [(row[4 * i], row[4 * i + 1], row[4 * i + 2], row[4 * i + 3]) for i in range(len(some))]
        return tuple(np.array([r[j] for r in out], dtype="float64") for j in range(4))

    def cumulative_at(self, days) -> np.ndarray:
        """Baseline cumulative hazard, linear between days, flat at both ends."""
        low, before, high, behind = self._known(days)
        return _between(days, low, before, high, behind)

    def survival_at(self, days) -> np.ndarray:
        """Baseline survival, linear between days, flat at both ends."""
        low, before, high, behind = self._known(days)
        return _between(days, low, np.exp(-before), high, np.exp(-behind))

    def cumulative_per_stratum(self, day: float) -> DataFrame:
        """``(level, total)``: the baseline cumulative hazard of every stratum at a day."""
        low, before, high, behind = _around(F.lit(float(day)))
        share = F.when(F.col("high") > F.col("low"), F.least((F.lit(float(day)) - F.col("low")) / (F.col("high") - F.col("low")), F.lit(1.0))).otherwise(0.0)
        rows = self.cells.groupBy(self.strata).agg(low.alias("low"), before.alias("before"), high.alias("high"), behind.alias("behind"))
        return rows.select(self.strata, (F.col("before") + share * (F.col("behind") - F.col("before"))).alias("total"))

    def baseline_table(self, spark=None) -> DataFrame:
        """``(t, hazard, cumulative, survival)`` per day, and per level with strata."""
        lead = [self.strata] if self.strata else []
        return self.cells.select(*lead, "t", "hazard", "cumulative", F.exp(-F.col("cumulative")).alias("survival"))

    def score(self, present: list[str] | None = None) -> Column:
        """``beta' (x - mean)`` of a row of raw covariates."""
        shift = float(self.fit.values @ self.means)
        return linear_predictor(self.fit.design, self.fit.lookup, present) - shift

    def probability(self, horizon: float, present: list[str] | None = None) -> Column:
        """Probability of a sale within the horizon; null on missing covariates."""
        if horizon <= 0:
            raise SchemaError("the horizon must be positive")
        total = float(self.cumulative_at(horizon)[0])
        return 1 - F.exp(-total * F.exp(self.score(present)))

    def with_probability(self, df: DataFrame, horizon: float, name: str = "probability", present: list[str] | None = None) -> DataFrame:
        """Add the probability of a sale within the horizon; null for a level the fit has not seen."""
        if horizon <= 0:
            raise SchemaError("the horizon must be positive")
        if self.strata is None:
            return df.withColumn(name, self.probability(horizon, present))
        known = self.cumulative_per_stratum(horizon).withColumnRenamed("total", "__total")
        rows = attach(df, known, [self.strata])
        return rows.withColumn(name, 1 - F.exp(-F.col("__total") * F.exp(self.score(present)))).select(*df.columns, name)

    def curve(self, days: list[float], present: list[str] | None = None) -> Column:
        """Array of ``(day, survival)`` for a row."""
        points = [
            F.struct(
                F.lit(float(d)).alias("day"),
                F.exp(-float(h) * F.exp(self.score(present))).alias("survival"),
            )
            for d, h in zip(days, self.cumulative_at(days))
        ]
        return F.array(*points)


def _around(day: Column) -> list[Column]:
    """Aggregates over cells: the last one up to a day, and the first one behind it or the last."""
    upto, behind = F.col("t") <= day, F.col("t") > day
    return [
        F.coalesce(F.max(F.when(upto, F.col("t"))), F.lit(0.0)),
        F.coalesce(F.max_by("cumulative", F.when(upto, F.col("t"))), F.lit(0.0)),
        F.coalesce(F.min(F.when(behind, F.col("t"))), F.max("t")),
        F.coalesce(F.min_by("cumulative", F.when(behind, F.col("t"))), F.max_by("cumulative", "t")),
    ]


def _between(days, low, before, high, behind) -> np.ndarray:
    days = np.atleast_1d(np.asarray(days, dtype="float64"))
    gap = np.where(high > low, high - low, 1.0)
    return before + np.clip((days - low) / gap, 0.0, 1.0) * (behind - before)


def premium_support(df: DataFrame, column: str = PRICE) -> dict[str, float] | None:
    """Range of the premium the fit has seen: min, max, 1st and 99th percentile, rows."""
    wanted = {"low": 0.0, "p1": 0.01, "p99": 0.99, "high": 1.0}
    row = grouped_quantiles(df, [], column, wanted, "n_observations").first()
    return None if row is None else row.asDict()


def recipe_of(design: Design) -> Recipe:
    """All columns of a design, centred and scaled as it learned them."""
    return Recipe(
        np.arange(len(design.names)), np.array([design.means[n] for n in design.names]), np.array([design.scale[n] for n in design.names])
    )


def prepare_rows(
    encoded: DataFrame, design: Design, duration: str = DURATION, event: str = EVENT, strata: str | None = None
) -> tuple[Passes, DataFrame | None]:
    """Lay encoded rows out for the passes; with strata also the numbers of their levels."""
    names = {n: f"x{i}" for i, n in enumerate(design.names)}
    levels = None
    if strata is not None:
        levels = settle(encoded.select(strata).distinct().withColumn("stratum", F.monotonically_increasing_id().cast("double")))
        encoded = attach(encoded, levels, [strata], "inner")
    rows = encoded.select(
        F.lit(0).alias("fit"), F.lit(0.0).alias("stratum") if strata is None else F.col("stratum"),
        col(duration).cast("double").alias("t"), col(event).cast("double").alias("e"),
        *[F.col(f"`{n}`").cast("double").alias(x) for n, x in names.items()],
    )
    return Passes(lay_out(rows, list(names.values()), design.rows_used), {0: recipe_of(design)}), levels


def fit_cox(
    df: DataFrame,
    covariates: list[str],
    categorical: list[str] = ["submarket", "season"],
    duration: str = DURATION,
    event: str = EVENT,
    building_effects: bool = False,
    ridge: float = 0.0,
    min_level: int = 5,
    with_concordance: bool = True,
    strata: str | None = None,
) -> CoxFit:
    """Fit time to sale; every estimate is returned in raw covariate units.

    ``building_effects`` gives each building a column, of which a design can hold a thousand.
    ``strata`` names a column whose levels, however many, have baselines of their own; rows
    without a level are left out, and levels without events add nothing.
    """
    if building_effects or strata == BUILDING:
        covariates = [c for c in covariates if c != "submarket"]
    flag = col(event).cast("double")
    usable = df.where((col(duration) > 0) & flag.isin(0.0, 1.0))
    # The fit reads its rows many times; they are made once, with the columns it needs.
    needed = [*covariates, *([BUILDING] if building_effects else []), duration, event, *([strata] if strata else [])]
    usable = settle(usable.select(*[F.col(f"`{c}`") for c in dict.fromkeys(needed) if c in df.columns]))
    notes: list[str] = []
    if strata is not None:
        missing = usable.where(F.col(strata).isNull()).count()
        usable = usable.where(F.col(strata).isNotNull())
        notes += [f"{strata}: {missing} rows without a level left out"] if missing else []
    design, encoded = learn_design(
        usable, covariates, categorical, [BUILDING] if building_effects else [],
        min_level, extra=[duration, event, *([strata] if strata else [])],
    )
    passes, levels = prepare_rows(encoded, design, duration, event, strata)
    found = maximise(passes, ridge)[0]
    if found.error and "two events" in found.error:
        raise SchemaError(found.error)
    point = found.checked().point
    scale = np.array([design.scale[n] for n in design.names])
    covariance = np.linalg.inv(found.information) / np.outer(scale, scale)
    cells = passes.cells({0: point})
    if levels is not None:
        cells = attach(cells, levels, ["stratum"], "inner")
    cells = settle(cells.drop("fit", "stratum"))
    events, many, last = cells.agg(F.sum("events"), F.count(F.lit(1)), F.max("t")).first()
    held = None
    if strata is None and many <= HELD_CELLS:
        table = cells.select("t", "cumulative").orderBy("t").toPandas()
        held = table["t"].to_numpy(), table["cumulative"].to_numpy()
    result = Fit(
        "cox", design.names, point.beta / scale, covariance, design, int(round(point.rows)), int(round(events)),
        stats={
            "log_likelihood": point.value,
            "aic_partial": -2 * point.value + 2 * len(design.names),
        },
        notes=[*notes, *design.notes, *found.notes, *_building_notes(design, building_effects, min_level)],
    )
    if strata is not None:
        result.stats["strata"] = float(levels.count())
    if with_concordance:
        from tidemark.operators.concordance import concordance

        score = linear_predictor(design, result.lookup)
        result.stats["concordance"] = concordance(usable, score, duration, event, strata)["concordance"]
    support = premium_support(encoded) if PRICE in design.names else None
    means = np.array([design.means[n] for n in design.names])
    return CoxFit(result, cells, float(last), support, means, strata, held)


def _building_notes(design: Design, used: bool, min_level: int) -> list[str]:
    if not used or BUILDING not in design.categories:
        return []
    category = design.categories[BUILDING]
    kept, pooled = len(category.levels) + 1, category.pooled
    notes = [f"building effects absorbed {kept} levels; submarket left out"]
    if pooled / (kept + pooled) > POOLED_ALARM:
        notes.append(f"MOSTLY POOLED: {pooled} of {kept + pooled} buildings under {min_level} rows")
    if design.rows_used / kept < THIN_LEVEL_ROWS:
        notes.append(f"THIN LEVELS: {design.rows_used / kept:.1f} rows per building")
    return notes


def with_candidate_price(df: DataFrame, price, reference: str = "cell_median_ppsf") -> DataFrame:
    """Put a candidate price in place of the listing's own premium."""
    return df.withColumn(PRICE, relative_premium(price, reference))


def day_residuals(df: DataFrame, cox: CoxFit, duration: str = DURATION, event: str = EVENT) -> DataFrame:
    """``(name, statistic, p_value)`` of the correlation of scaled residuals with ranked time.

    Per event day, the residual sum is the covariates of its events minus their
    risk-set mean; only sums over all days come back.
    """
    from tidemark.functions.distributions import chi_square_p

    if cox.strata is not None:
        raise SchemaError("residuals against time are for a fit without strata")
    design = cox.fit.design
    flag = col(event).cast("double")
    usable = df.where((col(duration) > 0) & flag.isin(0.0, 1.0))
    encoded = design.encoded(usable, col(duration).alias(duration), flag.alias(event))
    encoded = settle(encoded.na.drop(subset=[f"`{n}`" for n in design.names]))
    passes, _ = prepare_rows(encoded, design, duration, event)
    scale = np.array([design.scale[n] for n in design.names])
    found = passes.residual_sums(passes.evaluate({0: cox.fit.values * scale}))[0]
    total, middle = found["events"], found["rank"] / found["events"]
    variance = cox.fit.covariance * np.outer(scale, scale)
    scaled = total * (found["ranked"] - middle * found["left"]) @ variance
    spread = found["rank2"] - middle * found["rank"]
    statistic = scaled**2 / (total * np.diag(variance) * spread)
    return df.sparkSession.createDataFrame(
        [(n, float(s), chi_square_p(float(s), 1)) for n, s in zip(design.names, statistic)],
        "name string, statistic double, p_value double",
    )
