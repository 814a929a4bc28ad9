"""Least squares with absorbed factors: any number of levels, no column per level.

Columns are demeaned over the levels of every factor.  The rows are not rewritten for that: rows
that agree in all factors are one cell, and a cell's mean is all that demeaning moves.  With one
factor the cells are its levels and one round is exact; with more, the means of the cells are
demeaned over one factor after another until no level's mean is left.  The cross-products of the
demeaned rows follow from those of the rows, of the cell means and of what is left of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.errors import IdentificationError, SchemaError
from tidemark.operators.design import Design
from tidemark.operators.fits import Fit
from tidemark.operators.gram import NATIVE_COLUMNS, Gram, dependent_columns, gram
from tidemark.session import attach, settle

TOLERANCE = 1e-9
MAX_SWEEPS = 2_000


@dataclass
class Within:
    """Cross-products after demeaning, in standardised columns, and what undoes it."""

    columns: list[str]
    matrix: np.ndarray        # of the demeaned columns, p x p
    total: Gram               # of the raw columns
    scale: np.ndarray
    factors: list[str]
    levels: int               # parameters the factors take, the intercept included
    cells: DataFrame          # factors, n, and per column the part that was taken away
    sweeps: int

    @property
    def rows(self) -> float:
        return self.total.weight


def demean(rows: DataFrame, columns: list[str], factors: list[str], tolerance: float = TOLERANCE) -> Within:
    """Demean ``columns`` over ``factors``; rows with a null among them must be gone."""
    if not factors:
        raise SchemaError("no factor to absorb")
    if len(columns) <= NATIVE_COLUMNS:
        # Three readings of what made the rows would cost more than one copy of few columns.
        rows = settle(rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*factors, *columns])]))
    total = gram(rows, columns)
    deviations = total.deviations
    scale = np.where(deviations > 0, deviations, 1.0)
    names = [f"v{i}" for i in range(len(columns))]
    standard = rows.select(
        *[F.col(f).alias(f"f{i}") for i, f in enumerate(factors)],
        *[((F.col(f"`{c}`").cast("double") - float(m)) / float(s)).alias(n) for c, n, m, s in zip(columns, names, total.means, scale)],
    )
    keys = [f"f{i}" for i in range(len(factors))]
    cells = settle(standard.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in names]))
    left, sweeps = cells.select(*keys, "n", *names), 0
    levels = {k: cells.select(k).distinct().count() for k in keys}
    if len(keys) == 1:
        left = left.select(*keys, "n", *[F.lit(0.0).alias(v) for v in names])
    else:
        while True:
            sweeps += 1
            largest = 0.0
            for k in keys:
                mean = settle(left.groupBy(k).agg(*[(F.sum(F.col("n") * F.col(v)) / F.sum("n")).alias(f"m_{v}") for v in names]))
                gap = mean.agg(F.max(F.greatest(F.lit(0.0), *[F.abs(F.col(f"m_{v}")) for v in names]))).first()[0] or 0.0
                largest = max(largest, gap)
                left = attach(left, mean, [k]).select(*keys, "n", *[(F.col(v) - F.col(f"m_{v}")).alias(v) for v in names])
            left = settle(left)
            if largest < tolerance:
                break
            if sweeps == MAX_SWEEPS:
                raise IdentificationError(f"demeaning over {factors} did not settle in {MAX_SWEEPS} sweeps")
    inner = gram(standard, names).matrix[1:, 1:]
    inner = inner - gram(cells, names, "n").matrix[1:, 1:]
    if len(keys) > 1:
        inner = inner + gram(left, names, "n").matrix[1:, 1:]
    renamed = left.select(*keys, *[F.col(v).alias(f"l_{v}") for v in names])
    taken = attach(cells, renamed, keys).select(
        *[F.col(k).alias(f) for k, f in zip(keys, factors)], "n",
        *[((F.col(v) - F.col(f"l_{v}")) * float(s) + float(m)).alias(c) for c, v, m, s in zip(columns, names, total.means, scale)],
    )
    # Of two factors, every group of linked levels has one parameter too many; of more, each
    # further factor is taken to be linked throughout.
    spare = 0 if len(keys) == 1 else linked_groups(cells, *keys) if len(keys) == 2 else len(keys) - 1
    taken_up = sum(levels.values()) - spare
    return Within(list(columns), inner, total, scale, list(factors), taken_up, settle(taken), sweeps)


def linked_groups(cells: DataFrame, one: str, other: str) -> int:
    """Number of groups of levels of two factors that rows link, by passing on the least level."""
    pairs = settle(cells.select(one, other).distinct())
    labels = pairs.select(one, F.col(one).cast("string").alias("least")).distinct()
    while True:
        beside = attach(pairs, labels, [one]).groupBy(other).agg(F.min("least").alias("least"))
        passed = attach(pairs, beside, [other]).groupBy(one).agg(F.min("least").alias("now"))
        both = settle(attach(labels, passed, [one]))
        if both.filter("now < least").isEmpty():
            return both.select("now").distinct().count()
        labels = both.select(one, F.col("now").alias("least"))


@dataclass
class AbsorbedFit:
    """Slopes within the levels, and the level part of every cell of factors."""

    fit: Fit
    factors: list[str]
    effects: DataFrame        # factors, n, effect

    def with_prediction(self, df: DataFrame, slopes: Column, name: str = "predicted") -> DataFrame:
        """Add slopes plus the effect of the row's cell; null for a cell the fit has not seen."""
        known = self.effects.select(*self.factors, F.col("effect").alias("__effect"))
        return attach(df, known, self.factors).withColumn(name, slopes + F.col("__effect")).select(*df.columns, name)


def absorbed_least_squares(kind: str, rows: DataFrame, names: list[str], target: str, factors: list[str], design: Design | None = None) -> AbsorbedFit:
    """Least squares of ``target`` on ``names`` with the levels of ``factors`` absorbed.

    Columns that do not vary within the levels are left out and named in the notes.  There is no
    intercept: a cell's effect holds it.
    """
    within = demean(rows, [*names, target], factors)
    at = len(names)
    part = Gram(list(names), np.block([[np.array([[within.rows]]), np.zeros((1, at))], [np.zeros((at, 1)), within.matrix[:at, :at]]]))
    flat = [n for i, n in enumerate(names) if within.matrix[i, i] <= 1e-10 * within.rows]
    part = part.pick([n for n in names if n not in flat])
    spare = dependent_columns(part)
    kept = [n for n in names if n not in flat and n not in spare]
    if not kept:
        raise IdentificationError(f"no column varies within {factors}")
    own = [names.index(n) for n in kept]
    inverse = np.linalg.inv(within.matrix[np.ix_(own, own)])
    cross, spread = within.matrix[own, at], float(within.matrix[at, at])
    solved = inverse @ cross
    scale, unit = within.scale[own], float(within.scale[at])
    freedom = within.rows - len(kept) - within.levels
    if freedom <= 0:
        raise IdentificationError(f"{int(within.rows)} rows cannot carry {within.levels} levels")
    unexplained = max(spread - float(solved @ cross), 0.0) * unit**2
    variance = unexplained / freedom
    slopes = solved * unit / scale
    whole = float(within.total.covariance[at, at]) * within.rows
    if design is not None:
        design.terms = [t for t in design.terms if t.name in kept]
        design.dropped_dependent = [*design.dropped_dependent, *flat, *spare]
    notes = [f"absorbed {within.levels} levels of {', '.join(factors)}"]
    if flat or spare:
        notes.append(f"without variation within the levels: {sorted([*flat, *spare])[:5]}")
    fit = Fit(
        kind, kept, slopes, inverse / np.outer(scale, scale) * variance, design, int(within.rows), freedom=freedom,
        stats={
            "r_squared": 1 - unexplained / whole if whole > 0 else 0.0,
            "r_squared_within": float(solved @ cross) / spread if spread > 0 else 0.0,
            "residual_sd": math.sqrt(variance), "levels": float(within.levels), "sweeps": float(within.sweeps),
            "parameters": float(len(kept) + within.levels),
        },
        notes=notes,
    )
    effect = F.col(f"`{target}`")
    for n, b in zip(kept, slopes):
        effect = effect - F.lit(float(b)) * F.col(f"`{n}`")
    return AbsorbedFit(fit, list(factors), within.cells.select(*factors, "n", effect.alias("effect")))
