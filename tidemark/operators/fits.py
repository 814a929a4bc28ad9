"""The shape all fitted models share."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.distributions import NORMAL, normal_p, t_p, t_quantile
from tidemark.operators.design import Design

COEFFICIENT_SCHEMA = (
    "name string, value double, std_error double, ci_low double, ci_high double, p_value double"
)


@dataclass
class Fit:
    """Coefficients in raw units, their covariance, and the design they belong to."""

    kind: str
    names: list[str]
    values: np.ndarray
    covariance: np.ndarray
    design: Design | None
    rows: int
    events: int | None = None
    freedom: float | None = None
    stats: dict[str, float] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)

    def coefficient(self, name: str) -> dict[str, float] | None:
        """Value, error, 95 % interval and p-value of one column."""
        if name not in self.names:
            return None
        i = self.names.index(name)
        value, error = float(self.values[i]), math.sqrt(max(float(self.covariance[i, i]), 0.0))
        ratio = value / error if error > 0 else math.copysign(math.inf, value)
        if self.freedom is None:
            reach, p = NORMAL.inv_cdf(0.975), normal_p(ratio)
        else:
            reach, p = t_quantile(0.95, self.freedom), t_p(ratio, self.freedom)
        return {
            "name": name, "value": value, "std_error": error,
            "ci_low": value - reach * error, "ci_high": value + reach * error, "p_value": p,
        }

    @property
    def lookup(self) -> dict[str, float]:
        return dict(zip(self.names, self.values.tolist()))

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The fit as tables: coefficients, covariance, design columns, statistics."""
        rows = [tuple(self.coefficient(n).values()) for n in sorted(self.names)]
        pairs = [
            (a, b, float(self.covariance[i, j]))
            for i, a in enumerate(self.names)
            for j, b in enumerate(self.names)
        ]
        numbers = {"rows": float(self.rows), **self.stats}
        if self.events is not None:
            numbers["events"] = float(self.events)
        result = {
            "coefficients": spark.createDataFrame(rows, COEFFICIENT_SCHEMA),
            "covariance": spark.createDataFrame(pairs, "row string, column string, value double"),
            "fit_stats": spark.createDataFrame(
                [(k, float(v)) for k, v in numbers.items()], "stat string, value double"
            ),
            "notes": spark.createDataFrame([(n,) for n in self.notes], "note string"),
        }
        if self.design is not None:
            result["design_columns"] = self.design.summary(spark)
        return result
