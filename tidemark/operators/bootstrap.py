"""Two-stage bootstrap of the price coefficient on replicate weights.

Resampling rows with replacement gives each row a count that is nearly Poisson
with mean one, so a replicate is a column of hashed counts: no resample is ever
written, rows are laid out once, and a lost task recomputes the same counts.
All replicates are refitted side by side: one scan adds up every replicate's weighted cross-products
for the list-price surface, one lays the rows out with every replicate's own premium, and the
hazard passes step all replicates together, leaving out those that have converged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.errors import IdentificationError, SchemaError
from tidemark.functions.common import col, uniform
from tidemark.operators.gram import FAN_IN, Gram, least_squares
from tidemark.operators.hazard import LEAD, Passes, lay_out, maximise
from tidemark.operators.hedonic import PremiumModel
from tidemark.operators.survival import DURATION, EVENT, PRICE, CoxFit, recipe_of
from tidemark.session import settle

SEED = 20260731


def poisson_weight(u: Column, most: int = 18) -> Column:
    """Poisson count with mean one out of a uniform, by inversion.

    Counts above ``most`` are rarer than the steps of a double between 0 and 1.
    """
    total, chain = 0.0, None
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        chain = F.when(u < total, k) if chain is None else chain.when(u < total, k)
    return chain.otherwise(most).cast("double")


def replicate_weights(keys: list[str], replicates: int, seed: int = SEED) -> Column:
    """Array of weights of a row, one per replicate, out of its keys."""
    return F.array(*[poisson_weight(uniform(seed + r, *keys)) for r in range(replicates)])


@dataclass
class Bootstrap:
    """The draws of the coefficient and what they say about its error."""

    draws: list[float]
    failures: int
    point: float
    conventional_se: float

    @property
    def se(self) -> float:
        return float(np.std(self.draws, ddof=1))

    @property
    def ratio(self) -> float:
        return self.se / self.conventional_se if self.conventional_se > 0 else float("nan")

    @property
    def direction(self) -> str:
        if self.ratio > 1.05:
            return "understated"
        return "overstated" if self.ratio < 0.95 else "materially unchanged"

    def table(self, spark) -> DataFrame:
        """``(stat, value)``."""
        low, high = np.quantile(self.draws, [0.025, 0.975])
        numbers = {
            "point": self.point, "conventional_se": self.conventional_se, "bootstrap_se": self.se,
            "ci_low": low, "ci_high": high, "se_ratio": self.ratio,
            "succeeded": len(self.draws), "failed": self.failures,
        }
        return spark.createDataFrame([(k, float(v)) for k, v in numbers.items()], "stat string, value double")


def weighted_grams(rows: DataFrame, columns: list[str], weights: str, replicates: int) -> list[Gram]:
    """``Z'WZ`` of every replicate, ``Z = (1, columns)``, in one scan; null columns must be gone."""
    p = len(columns) + 1
    upper = np.triu_indices(p)
    chosen = rows.select(weights, *[F.col(f"`{c}`").cast("double").alias(f"z{i}") for i, c in enumerate(columns)])

    def partial(batches):
        total = np.zeros((replicates, len(upper[0])))
        for batch in batches:
            if len(batch):
                z = np.column_stack([np.ones(len(batch)), batch.iloc[:, 1:].to_numpy(dtype="float64")])
                for r, w in enumerate(np.stack(batch[weights].to_numpy()).T):
                    total[r] += ((z.T * w) @ z)[upper]
        yield pd.DataFrame({"r": np.arange(replicates), "part": TaskContext.get().partitionId() % FAN_IN, "m": list(total)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(m=[np.sum(np.stack(pdf["m"].to_numpy()), axis=0)])

    shape = "r int, part int, m array<double>"
    found = np.zeros((replicates, p, p))
    for row in chosen.mapInPandas(partial, shape).groupBy("r", "part").applyInPandas(add, shape).collect():
        found[row["r"]][upper] += row["m"]
    lower = np.tril_indices(p, -1)
    for m in found:
        m[lower] = m.T[lower]
    return [Gram(list(columns), m) for m in found]


def bootstrap_price(
    df: DataFrame,
    cox: CoxFit,
    premium: PremiumModel,
    keys: list[str],
    replicates: int = 60,
    price: str = "list_ppsf",
    duration: str = DURATION,
    event: str = EVENT,
    seed: int = SEED,
    weights: Column | None = None,
) -> Bootstrap:
    """Refit both stages of all replicates on weighted rows and collect the coefficient.

    ``weights`` is an array of a row's counts, one per replicate; by default they come from a
    hash of ``keys``.
    """
    surface, hazard = premium.fit.design, cox.fit.design
    raw = hazard.expressions()
    raw.pop(PRICE, None)
    flag = col(event).cast("double")
    rows = df.where((col(price) > 0) & (col(duration) > 0) & flag.isin(0.0, 1.0))
    x = {n: f"x{i}" for i, n in enumerate(hazard.names)}
    z = {n: f"s{i}" for i, n in enumerate(surface.names)}
    levels = {f"_level_{s}": c.value() for s, c in surface.categories.items()}
    priced = surface.expressions(staged=True)
    rows = settle(
        rows.withColumns(levels).select(
            F.lit(0).alias("fit"), F.lit(0.0).alias("stratum"), col(duration).cast("double").alias("t"), flag.alias("e"),
            *[(raw[n] if n in raw else F.lit(0.0)).cast("double").alias(x[n]) for n in hazard.names],
            (replicate_weights(keys, replicates, seed) if weights is None else weights).alias("w"), *[priced[n].cast("double").alias(z[n]) for n in surface.names],
            F.log(col(price)).alias("_y"),
        )
    )
    grams = weighted_grams(rows, [*z.values(), "_y"], "w", replicates)
    slopes, failed = np.zeros((len(z) + 1, replicates)), set()
    for r, moments in enumerate(grams):
        try:
            fit = least_squares(moments, "_y", _varying(moments, list(z.values())))
        except (IdentificationError, np.linalg.LinAlgError):
            failed.add(r)
            continue
        found = dict(zip(fit.names, fit.values))
        slopes[:, r] = [found["const"], *[found.get(c, 0.0) for c in z.values()]]
    p, at = len(x), hazard.names.index(PRICE)

    def with_premium(values: np.ndarray) -> np.ndarray:
        """Every replicate's own premium in place of the columns of the surface."""
        keep, columns = values[:, : LEAD + p + replicates], values[:, LEAD + p + replicates :]
        return np.hstack([keep, np.expm1(columns[:, -1:] - slopes[0] - columns[:, :-1] @ slopes[1:])])

    complete = rows.na.drop(subset=list(x.values()))
    layout = lay_out(complete, list(x.values()), complete.count(), replicates, at, with_premium)
    recipe = recipe_of(hazard)
    optima = maximise(Passes(layout, {r: recipe for r in range(replicates) if r not in failed}))
    draws = [float(o.point.beta[at] / hazard.scale[PRICE]) for _, o in sorted(optima.items()) if not o.error and not o.notes]
    if len(draws) < 2:
        raise SchemaError("too few replicates could be fitted")
    found = cox.fit.coefficient(PRICE)
    return Bootstrap(draws, replicates - len(draws), found["value"], found["std_error"])


def _varying(moments: Gram, names: list[str]) -> list[str]:
    """Columns that still vary in a replicate."""
    return [n for n, d in zip(moments.columns, moments.deviations) if d > 0 and n in names]
