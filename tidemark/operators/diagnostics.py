"""Graded checks of a fitted demand model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.errors import IdentificationError
from tidemark.functions.common import tally
from tidemark.operators.features import cell_sizes
from tidemark.operators.fits import Fit
from tidemark.operators.gram import condition_number, explained_share, inflation_factors
from tidemark.operators.quantiles import grouped_quantiles

# Thresholds of the checks.
PRICE = "rel_price_premium"
DISCRIMINATION = 0.60
CALIBRATION_GAP = 0.10
QUALITY_ALARM = 0.35
IQR_NARROW = 0.03
MIN_CELL = 8
SIGNS = (("log_floor", 1), ("inventory_competition", -1))
OPTIONAL_CONTROLS = {
    "view_description": "view_", "log_living_area": None, "building_name": None,
}

SCHEMA = "name string, requirement string, value double, status string, message string"


def sign_check(name: str, fit: Fit | None, column: str, sign: int, unconditional: bool) -> tuple:
    """Grade one coefficient: a wrong sign fails, or only warns when not significant."""
    requirement = f"coefficient {'< 0' if sign < 0 else '> 0'}"
    found = fit.coefficient(column) if fit else None
    if found is None:
        return name, requirement, None, "WARN", "not in the model"
    value = found["value"]
    if value * sign > 0:
        return name, requirement, value, "PASS", "right sign"
    significant = found["ci_low"] > 0 or found["ci_high"] < 0
    failed = unconditional or significant
    return name, requirement, value, "FAILED" if failed else "WARN", "wrong sign" + (
        "" if failed else ", interval covers zero"
    )


@dataclass
class Diagnosis:
    """Overall status, the checks, and the identification numbers."""

    status: str
    checks: DataFrame
    identification: DataFrame
    warnings: DataFrame


def diagnose(
    df: DataFrame,
    cox: Fit,
    logit: Fit | None = None,
    calibration: DataFrame | None = None,
    premium_is_residual: bool = False,
    min_cell: int = MIN_CELL,
) -> Diagnosis:
    """All checks of a fit over the feature table it was fitted on."""
    spark: SparkSession = df.sparkSession
    checks = [sign_check("cox_price", cox, PRICE, -1, True)]
    if logit is not None:
        checks.append(sign_check("logit_price", logit, PRICE, -1, True))
    else:
        checks.append(("logit_cross_check", "fitted", None, "WARN", "no logit to corroborate"))
    for column, sign in SIGNS:
        if column == "log_floor" and premium_is_residual:
            found = cox.coefficient(column)
            checks.append(
                (column, "reported only: the premium is floor-adjusted", found and found["value"], "PASS", "")
            )
        else:
            checks.append(sign_check(column, cox, column, sign, False))
    for marker in ("CONVERGENCE", "MOSTLY POOLED", "THIN LEVELS"):
        hit = next((n for n in cox.notes if marker in n), None)
        if hit:
            checks.append((marker.lower().replace(" ", "_"), "none", None, "WARN", hit))

    def threshold(name: str, value: float | None, limit: float, above: bool) -> None:
        fine = value is not None and value == value and (value >= limit if above else value <= limit)
        sign = ">=" if above else "<="
        checks.append((name, f"{sign} {limit}", value, "PASS" if fine else "WARN", ""))

    threshold("cox_concordance", cox.stats.get("concordance"), DISCRIMINATION, True)
    if logit is not None:
        threshold("logit_auc_holdout", logit.stats.get("auc_holdout"), DISCRIMINATION, True)
    if calibration is not None:
        gap = calibration.agg(F.max(F.abs(F.col("predicted_mean") - F.col("observed_rate")))).first()[0]
        if gap is not None:
            threshold("calibration_gap", gap, CALIBRATION_GAP, False)

    sums = df.agg(
        tally(F.col("event_sold") == 1).alias("sold"), tally(F.col("event_sold") == 0).alias("censored")
    ).first()
    iqr = None
    found = grouped_quantiles(df, [], PRICE, {"a": 0.25, "b": 0.75}).first()
    if found:
        iqr = found["b"] - found["a"]
    cells = None
    if {"submarket", "list_month"} <= set(df.columns):
        cells = cell_sizes(df, ["submarket", "list_month"]).where(F.col("n") >= min_cell).count()
    share = explained_share(cox.design.gram, PRICE) if cox.design and cox.design.gram else None
    beta = cox.coefficient(PRICE)
    covers_zero = beta is None or (beta["ci_low"] <= 0 <= beta["ci_high"])

    warnings = [f"{c[0]}: {c[4] or 'below its threshold'}" for c in checks if c[3] == "WARN"]
    if beta is not None and covers_zero:
        warnings.append("the price coefficient's interval covers zero")
    if iqr is not None and iqr < IQR_NARROW:
        warnings.append("the premium hardly varies")
    if share is not None and share >= QUALITY_ALARM:
        warnings.append("the premium is largely explained by unit characteristics")
    controls = set(cox.names)
    for column, prefix in OPTIONAL_CONTROLS.items():
        used = column in controls or any(
            n.startswith(f"{column}=") or (prefix and n.startswith(prefix)) for n in controls
        )
        if column in df.columns and not used and df.where(F.col(column).isNotNull()).limit(1).count():
            warnings.append(f"not controlled for: {column}")
    if any(c[3] == "FAILED" for c in checks):
        status = "FAILED"
    else:
        status = "WARN" if warnings else "PASS"
    numbers = [
        ("sold", float(sums["sold"])), ("censored", float(sums["censored"])),
        ("dense_cells", None if cells is None else float(cells)), ("premium_iqr", iqr),
        ("quality_share", share), ("beta_price", beta and beta["value"]),
        ("rows_fitted", float(cox.rows)),
    ]
    if cox.design is not None:
        numbers += [(f"null_{c}", float(n)) for c, n in sorted(cox.design.null_counts.items())]
    return Diagnosis(
        status,
        spark.createDataFrame(checks, SCHEMA),
        spark.createDataFrame(numbers, "measure string, value double"),
        spark.createDataFrame([(w,) for w in warnings], "warning string"),
    )


def require_pass(diagnosis: Diagnosis) -> None:
    """Raise when a blocking check failed."""
    if diagnosis.status != "FAILED":
        return
    failed = [r["name"] for r in diagnosis.checks.where(F.col("status") == "FAILED").collect()]
    raise IdentificationError(f"blocking checks failed: {failed}")


def collinearity(spark: SparkSession, fit: Fit) -> DataFrame:
    """Variance inflation of every design column, and the condition number."""
    rows = list(inflation_factors(fit.design.gram).items())
    rows.append(("condition_number", condition_number(fit.design.gram)))
    return spark.createDataFrame([(n, float(v)) for n, v in rows], "name string, value double")
