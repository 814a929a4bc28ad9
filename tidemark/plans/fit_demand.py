"""The fit job: features to hazard, logit, close surface, checks and comparables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidemark.errors import IdentificationError, SchemaError
from tidemark.operators import diagnostics, hedonic, keyed, logit, survival
from tidemark.operators.design import available
from tidemark.operators.features import COVARIATES, FeatureTable
from tidemark.operators.profile import fit_time_comps
from tidemark.session import settle
from tidemark.sources.reports import write_tables

# The controlled covariates of the hazard and the logit.
CONTROLLED = [*[c for c in COVARIATES if c != "living_area_sqft"], "log_living_area"]
CATEGORICAL = ["submarket", "season"]
TREATMENTS = ("censored", "excluded", "event")
VIEW_PREFIX = "view_"


@dataclass
class DemandFit:
    """Everything a fit produced."""

    cox: survival.CoxFit
    logit: logit.LogitFit | None
    close: hedonic.CloseSurface
    diagnosis: diagnostics.Diagnosis
    comps: DataFrame
    features: FeatureTable

    def tables(self, spark) -> dict[str, DataFrame]:
        """All results as tables, ready for :func:`write_tables`."""
        result = {f"cox_{k}": v for k, v in self.cox.fit.tables(spark).items()}
        result["cox_baseline"] = self.cox.baseline_table(spark)
        if self.logit is not None:
            result |= {f"logit_{k}": v for k, v in self.logit.fit.tables(spark).items()}
        result |= {f"close_{k}": v for k, v in self.close.fit.tables(spark).items()}
        result["checks"] = self.diagnosis.checks
        result["identification"] = self.diagnosis.identification
        result["comps"] = self.comps
        return result


def chosen_covariates(features: FeatureTable, controls: bool = True) -> list[str]:
    """Covariates the table carries, view indicators included."""
    wanted = CONTROLLED if controls else list(COVARIATES)
    present = available(features.frame, wanted)
    tokens = [n for n in features.frame.columns if n.startswith(VIEW_PREFIX) and n != "view_description"]
    return present + (sorted(tokens) if controls else [])


def fit_demand(
    features: FeatureTable,
    real_data: bool,
    calibration_gate: bool = False,
    horizon: int = 180,
    controls: bool = True,
    building_effects: bool = False,
    id_columns: list[str] = [],
    strata: str | None = None,
) -> DemandFit:
    """Fit every model over one feature table.

    A fit on real data has to be asked for with ``calibration_gate``.  With ``strata``
    (buildings, say) the hazard has a baseline per level and the close surface absorbs them.
    """
    if real_data and not calibration_gate:
        raise SchemaError("refused: a fit on real data needs calibration_gate=True")
    frame = features.frame
    covariates = chosen_covariates(features, controls)
    cox = survival.fit_cox(frame, covariates, CATEGORICAL, building_effects=building_effects, strata=strata)
    logit_fit = None
    deciles = None
    try:
        logit_fit = logit.fit_logit(frame, covariates, horizon, CATEGORICAL, id_columns)
        scored = settle(
            frame.select(
                logit_fit.probability().alias("predicted"), logit.horizon_label(horizon).alias("observed")
            )
        )
        deciles = logit.calibration(scored, "predicted", "observed")
    except (SchemaError, IdentificationError):
        logit_fit = None
    close = hedonic.fit_close(frame, absorb=[strata] if strata else [])
    residual = features.premium_model is not None
    diagnosis = diagnostics.diagnose(frame, cox.fit, logit_fit and logit_fit.fit, deciles, residual)
    return DemandFit(cox, logit_fit, close, diagnosis, fit_time_comps(frame), features)


def cancelled_sweep(build, covariates: list[str], categorical: list[str] = CATEGORICAL) -> DataFrame:
    """The price coefficient under each coding of cancelled listings, all fitted in one run.

    ``build(choice)`` returns the feature table, or its frame, for one coding.
    """
    stacked = None
    names = [survival.DURATION, survival.EVENT, *covariates]
    for choice in TREATMENTS:
        frame = build(choice)
        frame = getattr(frame, "frame", frame).select(F.lit(choice).alias("treatment"), *names)
        stacked = frame if stacked is None else stacked.unionByName(frame)
    stacked = settle(stacked)
    fits = keyed.fit_cox_by(stacked, "treatment", covariates, categorical)
    events = stacked.groupBy("treatment").agg(F.sum(F.col(survival.EVENT).cast("bigint")).alias("events"))
    table = keyed.sweep_table(stacked.sparkSession, fits, order=list(TREATMENTS)).drop("events")
    return table.join(events, "treatment", "left").select(
        "treatment", "rows", F.when(F.col("error").isNull(), F.col("events")).alias("events"), "beta_price", "ci_low", "ci_high", "error"
    )


def save(fit: DemandFit, folder: str) -> dict[str, str]:
    """Write all tables of a fit."""
    return write_tables(fit.tables(fit.comps.sparkSession), folder)
