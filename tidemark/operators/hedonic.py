"""Hedonic surfaces: list-price reference, close-price bounds, floor premium."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.errors import IdentificationError, SchemaError
from tidemark.functions.common import col
from tidemark.operators.absorb import AbsorbedFit, absorbed_least_squares
from tidemark.operators.design import (
    Design, available, learn_design, learn_filled_design, linear_predictor,
)
from tidemark.operators.fits import Fit
from tidemark.operators.gram import dependent_columns, gram, least_squares

# Right-hand sides and limits of the two surfaces.
LIST_NUMERIC = [
    "log_living_area", "log_floor", "beds", "baths_full", "hoa_per_sqft",
    "building_age_years", "total_stories", "min_lease_days_value",
    "min_lease_days_missing",
]
LIST_CATEGORICAL = [
    "submarket", "list_month", "furnished_info_level",
    "special_assessment_level", "association_type_level",
]
CLOSE_COVARIATES = [
    "log_floor", "log_living_area", "beds", "baths_full", "hoa_per_sqft",
    "is_new_construction", "submarket", "view_description", "list_quarter",
]
CLOSE_CATEGORICAL = ["submarket", "view_description", "list_quarter"]
MIN_LISTINGS = 200
MIN_SALES = 50
BOUND_SD = 1.5
REFERENCE_FLOOR = 1.0


@dataclass
class PremiumModel:
    """The list-price surface: reference price and premium of any unit."""

    fit: Fit

    def reference(self, present: list[str] | None = None) -> Column:
        """Predicted price per square foot by the fitted vocabulary."""
        return F.exp(linear_predictor(self.fit.design, self.fit.lookup, present))

    def columns(self, price: str = "list_ppsf", present: list[str] | None = None) -> dict[str, Column]:
        """Premium in logs and as a ratio, the reference, and the source label."""
        usable = col(price) > 0
        fitted = linear_predictor(self.fit.design, self.fit.lookup, present)
        gap = F.when(usable, F.log(col(price)) - fitted)
        return {
            "hedonic_price_premium": gap,
            "hedonic_reference_ppsf": F.when(usable, F.exp(fitted)),
            "hedonic_price_premium_source": F.when(usable, "hedonic_residual").otherwise("missing"),
        }


def least_squares_fit(kind: str, rows: DataFrame, design: Design, target: str) -> Fit:
    """Ordinary least squares of a target column on encoded design columns."""
    moments = gram(rows, [*design.names, target])
    names = design.names
    if design.gram is None:
        flat = [n for n, d in zip(moments.columns, moments.deviations) if d == 0.0 and n != target]
        names = [n for n in names if n not in flat]
        spare = dependent_columns(moments.pick(names))
        # An intercept is fitted too, so a full set of dummies is also redundant.
        names = [n for n in names if n not in spare]
        names = _independent_of_intercept(moments, names)
        design.terms = [t for t in design.terms if t.name in names]
        design.dropped_constant, design.dropped_dependent = flat, spare
    solved = least_squares(moments, target, names)
    return Fit(
        kind, solved.names, solved.values, solved.covariance, design, int(solved.rows),
        freedom=solved.freedom,
        stats={
            "r_squared": solved.r_squared,
            "r_squared_adj": solved.r_squared_adjusted,
            "residual_sd": math.sqrt(solved.residual_variance),
            "residual_sd_plain": math.sqrt(
                solved.residual_variance * solved.freedom / max(solved.rows - 1, 1)
            ),
            "total_variance": solved.total_variance,
            "parameters": float(len(solved.names)),
        },
    )


def _independent_of_intercept(moments, names: list[str]) -> list[str]:
    """Drop columns that the intercept and the other columns already span."""
    kept: list[str] = []
    part = moments.pick(names)
    deviations = part.deviations
    cov = part.covariance / np.outer(deviations, deviations)
    left = cov.copy()
    for i, name in enumerate(names):
        if left[i, i] > 1e-9:
            kept.append(name)
            left = left - np.outer(left[:, i], left[i, :]) / left[i, i]
    return kept


def fit_premium(
    df: DataFrame,
    price: str = "list_ppsf",
    numeric: list[str] = LIST_NUMERIC,
    categorical: list[str] = LIST_CATEGORICAL,
    tokens: list[str] = [],
    weight: str | None = None,
) -> PremiumModel:
    """Fit log price per square foot on everything about the unit, place and month.

    Encoding choices see every row; the regression sees rows with a price.
    """
    usable = df.where(col(price) > 0)
    n = usable.count()
    if n < MIN_LISTINGS:
        raise SchemaError(f"the list-price surface needs {MIN_LISTINGS} priced rows, found {n}")
    design = learn_filled_design(df, numeric, tokens, categorical)
    rows = design.encoded(usable, F.log(col(price)).alias("_y"))
    return PremiumModel(least_squares_fit("list_hedonic", rows, design, "_y"))


def score_premium(df: DataFrame, model: PremiumModel | None, price: str = "list_ppsf") -> DataFrame:
    """Respecify the premium as the residual, the old version kept beside it."""
    if model is None:
        nothing = F.lit(None).cast("double")
        return df.withColumns(
            {
                "cell_median_ppsf_raw": F.col("cell_median_ppsf"),
                "hedonic_price_premium": nothing,
                "hedonic_price_premium_ratio": nothing,
                "hedonic_reference_ppsf": nothing,
                "hedonic_price_premium_source": F.lit("unavailable"),
                "rel_price_premium_spec": F.lit("cell_median"),
            }
        )
    usable = col(price) > 0
    df = df.withColumn("_fitted", linear_predictor(model.fit.design, model.fit.lookup))
    df = df.withColumns(
        {
            "hedonic_price_premium": F.when(usable, F.log(col(price)) - F.col("_fitted")),
            "hedonic_reference_ppsf": F.when(usable, F.exp("_fitted")),
            "hedonic_price_premium_source": F.when(usable, "hedonic_residual").otherwise("missing"),
        }
    ).drop("_fitted")
    ratio = F.expm1("hedonic_price_premium")
    known = ratio.isNotNull() & F.col("hedonic_reference_ppsf").isNotNull()
    return df.withColumns(
        {
            "hedonic_price_premium_ratio": ratio,
            "cell_median_ppsf_raw": F.col("cell_median_ppsf"),
            "rel_price_premium": F.when(known, ratio),
            "cell_median_ppsf": F.when(known, F.col("hedonic_reference_ppsf")),
            "rel_price_premium_spec": F.when(known, "hedonic_residual").otherwise("unavailable"),
        }
    )


@dataclass
class CloseSurface:
    """The close-price surface: what a unit is worth, and a band around it."""

    fit: Fit
    bound_sd: float
    floor_premium: dict[str, float]
    absorbed: AbsorbedFit | None = None

    def columns(self, present: list[str] | None = None) -> dict[str, Column]:
        """Predicted price per square foot and the band of ``bound_sd`` deviations."""
        if self.absorbed is not None:
            raise SchemaError(f"levels of {self.absorbed.factors} were absorbed; use with_columns")
        return self._band(linear_predictor(self.fit.design, self.fit.lookup, present))

    def with_columns(self, df: DataFrame, present: list[str] | None = None) -> DataFrame:
        """Add prediction and band; null for a level of an absorbed factor that the fit has not seen."""
        if self.absorbed is None:
            return df.withColumns(self.columns(present))
        slopes = linear_predictor(self.fit.design, self.fit.lookup, present)
        scored = self.absorbed.with_prediction(df, slopes, "__log")
        return scored.withColumns(self._band(F.col("__log"))).drop("__log")

    def _band(self, log_price: Column) -> dict[str, Column]:
        predicted = F.exp(log_price)
        spread = self.bound_sd * self.fit.stats["residual_sd"]
        return {
            "predicted_ppsf": predicted,
            "p_floor_ppsf": predicted * math.exp(-spread),
            "p_ceiling_ppsf": predicted * math.exp(spread),
        }

    def floor_log_premium(self, floor) -> Column:
        """``alpha * ln(floor + 1) + gamma``, zero at the reference floor."""
        floor = col(floor)
        alpha, gamma = self.floor_premium["alpha"], self.floor_premium["gamma"]
        return F.when(floor >= 0, alpha * F.log1p(floor) + gamma)


def fit_close(
    df: DataFrame,
    price: str = "close_ppsf",
    covariates: list[str] = CLOSE_COVARIATES,
    categorical: list[str] = CLOSE_CATEGORICAL,
    bound_sd: float = BOUND_SD,
    min_sales: int = MIN_SALES,
    reference_floor: float = REFERENCE_FLOOR,
    absorb: list[str] = [],
) -> CloseSurface:
    """Fit log close price per square foot over closed sales.

    The levels of the ``absorb`` columns (buildings, say), however many, have effects of their own
    without a column each; sales without such a level are left out.
    """
    if reference_floor < 0:
        raise SchemaError("reference_floor must not be negative")
    sold = df.where(col(price) > 0)
    n = sold.count()
    if n < min_sales:
        raise SchemaError(f"the close-price surface needs {min_sales} sales, found {n}")
    present = [c for c in available(sold, covariates) if c not in absorb]
    sold = sold.withColumn("_y", F.log(col(price)))
    for name in absorb:
        sold = sold.where(F.col(name).isNotNull())
    design, rows = learn_design(
        sold, present, [c for c in categorical if c in present], extra=["_y", *absorb]
    )
    absorbed = absorbed_least_squares("close_hedonic", rows, design.names, "_y", absorb, design) if absorb else None
    fit = absorbed.fit if absorbed else least_squares_fit("close_hedonic", rows, design, "_y")
    skipped = [c for c in covariates if c not in present]
    fit.notes = [*design.notes, *(fit.notes if absorbed else [])] + ([f"absent or empty covariates: {skipped}"] if skipped else [])
    alpha = fit.coefficient("log_floor")
    if alpha is None:
        raise IdentificationError("no log_floor term, so the floor premium is not identified")
    shift = math.log(reference_floor + 1.0)
    curve = {
        "alpha": alpha["value"], "gamma": -alpha["value"] * shift,
        "alpha_std_error": alpha["std_error"], "gamma_std_error": alpha["std_error"] * shift,
        "reference_floor": reference_floor,
    }
    return CloseSurface(fit, bound_sd, curve, absorbed)
