"""The horizon logit, its held-out check, and the constant-hazard cross-check."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.errors import IdentificationError, SchemaError
from tidemark.functions.common import col, tally
from tidemark.operators.design import Design, learn_design, linear_predictor
from tidemark.operators.fits import Fit
from tidemark.operators.gram import gram
from tidemark.operators.quantiles import bucket_edges, grouped_quantiles, right_closed_bucket
from tidemark.operators.split import with_test_mark
from tidemark.session import settle

TEST_SHARE = 0.25
SEED = 20240101
CALIBRATION_BINS = 10


def horizon_label(horizon: int, duration="duration_days", event="event_sold") -> Column:
    """1 sold by the horizon, 0 outlasted it, null unknown."""
    if horizon <= 0:
        raise SchemaError("the horizon must be positive")
    days, sold = col(duration), col(event).cast("double")
    valid = (days > 0) & sold.isin(0.0, 1.0)
    return F.when(valid & (sold == 1) & (days <= horizon), 1.0).when(
        valid & (days >= horizon), 0.0
    )


def horizon_counts(df: DataFrame, horizon: int, keys: list[str] = [], **names: str) -> DataFrame:
    """Rows sold by, surviving, and unknown at the horizon."""
    label = horizon_label(horizon, **names)
    return df.groupBy(*keys).agg(
        tally(label == 1).alias("sold_by_horizon"),
        tally(label == 0).alias("survived_horizon"),
        tally(label.isNull()).alias("unknown_at_horizon"),
    )


def _assembled(rows: DataFrame, design: Design) -> DataFrame:
    scaled = rows.withColumns(
        {f"x{i}": F.col(f"`{n}`") / design.scale[n] for i, n in enumerate(design.names)}
    )
    return VectorAssembler(
        inputCols=[f"x{i}" for i in range(len(design.names))], outputCol="features"
    ).transform(scaled)


def _glm(rows: DataFrame, design: Design, family: str, label: str, offset: str | None = None):
    model = GeneralizedLinearRegression(
        family=family, labelCol=label, featuresCol="features", maxIter=100, tol=1e-9
    )
    if offset:
        model = model.setOffsetCol(offset)
    return model.fit(_assembled(rows, design))


def _covariance(
    rows: DataFrame, design: Design, lookup: dict[str, float], family: str, offset: str | None = None
) -> np.ndarray:
    """Inverse information at the optimum, by one weighted Gram pass."""
    eta = F.lit(lookup["const"])
    for name in design.names:
        eta = eta + lookup[name] * F.col(f"`{name}`")
    if offset:
        eta = eta + F.col(offset)
    mean = 1 / (1 + F.exp(-eta)) if family == "binomial" else F.exp(eta)
    weight = mean * (1 - mean) if family == "binomial" else mean
    weighted = gram(rows.withColumn("_w", weight), design.names, "_w")
    size = np.sqrt(np.diag(weighted.matrix))
    return np.linalg.inv(weighted.matrix / np.outer(size, size)) / np.outer(size, size)


@dataclass
class LogitFit:
    """A fitted horizon logit."""

    fit: Fit
    horizon: int

    def probability(self, horizon: int | None = None, present: list[str] | None = None) -> Column:
        """Probability of a sale within the fitted horizon, and no other."""
        if horizon is not None and horizon != self.horizon:
            raise SchemaError(f"fitted at {self.horizon} days, not {horizon}")
        eta = linear_predictor(self.fit.design, self.fit.lookup, present)
        return 1 / (1 + F.exp(-eta))


def fit_logit(
    df: DataFrame,
    covariates: list[str],
    horizon: int = 180,
    categorical: list[str] = ["submarket", "season"],
    id_columns: list[str] = [],
    duration: str = "duration_days",
    event: str = "event_sold",
    held_out: bool = True,
) -> LogitFit:
    """Fit the sale-by-horizon logit on rows whose outcome is known."""
    labelled = df.withColumn("_label", horizon_label(horizon, duration, event))
    labelled = labelled.where(F.col("_label").isNotNull())
    design, rows = learn_design(labelled, covariates, categorical, extra=["_label", *id_columns])
    rows = settle(rows)
    sums = rows.agg(F.count("*").alias("n"), F.sum("_label").alias("k")).first()
    n, k = sums["n"], sums["k"]
    if not 0 < k < n:
        raise IdentificationError("every usable row has the same outcome")
    model = _glm(rows, design, "binomial", "_label")
    values = np.concatenate(
        [[model.intercept], model.coefficients.toArray() / [design.scale[c] for c in design.names]]
    )
    names = ["const", *design.names]
    lookup = dict(zip(names, values.tolist()))
    deviance = model.summary.deviance
    share = k / n
    null_likelihood = k * np.log(share) + (n - k) * np.log(1 - share)
    fit = Fit(
        "logistic", names, values, _covariance(rows, design, lookup, "binomial"), design, n, int(k),
        stats={
            "log_likelihood": -deviance / 2,
            "pseudo_r2_mcfadden": 1 - (-deviance / 2) / null_likelihood,
            "horizon_days": float(horizon),
        },
        notes=list(design.notes),
    )
    if held_out:
        fit.stats["auc_holdout"] = _held_out_auc(rows, design, id_columns)
    return LogitFit(fit, horizon)


def _held_out_auc(rows: DataFrame, design: Design, id_columns: list[str]) -> float:
    """AUC on exactly a quarter of each outcome class, chosen by row hash; NaN when not viable.

    Whether one covariate separates the classes is tested before the fit; of the solver's errors
    only those that name a singular system count as not viable.
    """
    keys = id_columns or [f"`{n}`" for n in design.names]
    marked = settle(with_test_mark(rows, "_label", TEST_SHARE, keys, SEED))
    train, test = marked.where(~F.col("_test")), marked.where(F.col("_test"))
    classes = marked.groupBy("_test", "_label").agg(
        F.count("*").alias("n"), *[f(f"`{n}`").alias(f"{k}{i}") for i, n in enumerate(design.names) for k, f in (("lo", F.min), ("hi", F.max))]
    ).collect()
    sizes = {(r["_test"], r["_label"]): r for r in classes}
    if any((t, y) not in sizes for t in (True, False) for y in (0.0, 1.0)):
        return float("nan")
    no, yes = sizes[False, 0.0], sizes[False, 1.0]
    if any(no[f"hi{i}"] < yes[f"lo{i}"] or yes[f"hi{i}"] < no[f"lo{i}"] for i in range(len(design.names))):
        return float("nan")
    try:
        model = _glm(train, design, "binomial", "_label")
    except (Py4JJavaError, CapturedException) as error:
        if not _singular(error):
            raise
        return float("nan")
    scored = model.transform(_assembled(test, design))
    return BinaryClassificationEvaluator(
        rawPredictionCol="prediction", labelCol="_label", metricName="areaUnderROC", numBins=0
    ).evaluate(scored)


def _singular(error) -> bool:
    """Whether the solver found a singular system, told by the class of an exception in the chain."""
    cause = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    while cause is not None:
        if cause.getClass().getSimpleName() == "SingularMatrixException":
            return True
        cause = cause.getCause()
    return False


def fit_exponential(df: DataFrame, covariates: list[str], exposure: str, event: str) -> Fit:
    """Constant-hazard survival: Poisson regression of the event with log exposure offset."""
    rows = df.where((col(exposure) > 0) & col(event).isNotNull()).withColumns(
        {"_offset": F.log(exposure), "_event": col(event).cast("double")}
    )
    design, encoded = learn_design(rows, covariates, [], extra=["_offset", "_event"])
    encoded = settle(encoded)
    model = _glm(encoded, design, "poisson", "_event", "_offset")
    names = ["const", *design.names]
    values = np.concatenate(
        [[model.intercept], model.coefficients.toArray() / [design.scale[c] for c in design.names]]
    )
    lookup = dict(zip(names, values.tolist()))
    return Fit(
        "exponential", names, values,
        _covariance(encoded, design, lookup, "poisson", "_offset"), design,
        design.rows_used, stats={"deviance": model.summary.deviance},
    )


def calibration(
    df: DataFrame, predicted: str, observed: str, bins: int = CALIBRATION_BINS
) -> DataFrame:
    """``(decile, n, predicted_mean, observed_rate)`` by quantile of the prediction."""
    rows = df.where(F.col(predicted).isNotNull() & F.col(observed).isNotNull())
    rows = settle(rows.select(*dict.fromkeys([predicted, observed])))
    wanted = {f"q{i}": i / bins for i in range(bins + 1)}
    found = grouped_quantiles(rows, [], predicted, wanted).first()
    edges = bucket_edges(list(found)) if found else []
    if len(edges) < 2:
        return rows.limit(0).select(
            F.lit(0).alias("decile"), F.lit(0).cast("bigint").alias("n"),
            F.lit(0.0).alias("predicted_mean"), F.lit(0.0).alias("observed_rate"),
        )
    return (
        rows.groupBy(right_closed_bucket(predicted, edges).alias("decile"))
        .agg(
            F.count("*").alias("n"),
            F.avg(predicted).alias("predicted_mean"),
            F.avg(observed).alias("observed_rate"),
        )
    )
