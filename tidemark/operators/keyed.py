"""One hazard fit per level of a key, all in the same few jobs.

Every key learns its own columns: complete rows, kept levels, constants, dependent columns,
means and scales come from counts and cross-products per key.  The rows are laid out once, each
under its key, with the union of all keys' columns; a fit reads its own of them.  The
hazard passes step all keys together until each has converged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.errors import SchemaError
from tidemark.functions.common import all_of, col, tally
from tidemark.operators.design import MIN_LEVEL, RARE, Category, Design, Term, settle_columns
from tidemark.operators.fits import Fit
from tidemark.operators.gram import FAN_IN, MAX_COLUMNS, Gram
from tidemark.operators.hazard import Passes, Recipe, lay_out, maximise
from tidemark.operators.survival import DURATION, EVENT, PRICE
from tidemark.session import land

MAX_KEYS = 200  # fits of one run; their designs are on the driver


def keyed_grams(rows: DataFrame, key: str, columns: list[str], keys: int) -> list[Gram]:
    """``Z'Z`` per number of a key, ``Z = (1, columns)``, in one scan."""
    p = len(columns) + 1
    upper = np.triu_indices(p)
    chosen = rows.select(F.col(key).cast("int").alias("k"), *[F.col(f"`{c}`").cast("double").alias(f"z{i}") for i, c in enumerate(columns)])

    def partial(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            own = batch["k"].to_numpy()
            values = np.column_stack([np.ones(len(batch)), batch.iloc[:, 1:].to_numpy(dtype="float64")])
            for k in np.unique(own).tolist():
                z = values[own == k]
                total[k] = total.get(k, 0.0) + (z.T @ z)[upper]
        if total:
            yield pd.DataFrame({"k": list(total), "part": TaskContext.get().partitionId() % FAN_IN, "m": list(total.values())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(m=[np.sum(np.stack(pdf["m"].to_numpy()), axis=0)])

    shape = "k int, part int, m array<double>"
    found = np.zeros((keys, p, p))
    for row in chosen.mapInPandas(partial, shape).groupBy("k", "part").applyInPandas(add, shape).collect():
        found[row["k"]][upper] += row["m"]
    lower = np.tril_indices(p, -1)
    for m in found:
        m[lower] = m.T[lower]
    return [Gram(list(columns), m) for m in found]


def _counts(df: DataFrame, key: str, usable: dict[str, Column], numeric: list[str]) -> list:
    """Rows, complete rows, and per column nulls and values other than 0 and 1, of every key."""
    complete = all_of(usable.values())
    found = df.groupBy(key).agg(
        F.count("*").alias("__rows"), tally(complete).alias("__used"),
        *[tally(~ok).alias(f"__null_{i}") for i, ok in enumerate(usable.values())],
        *[tally(complete & ~F.col(c).cast("double").isin(0.0, 1.0)).alias(f"__other_{i}") for i, c in enumerate(numeric)],
    ).limit(MAX_KEYS + 1).collect()
    if len(found) > MAX_KEYS:
        raise SchemaError(f"more than {MAX_KEYS} keys; fit them in several runs")
    return sorted(found, key=lambda r: str(r[key]))


def _levels(rows: DataFrame, key: str, sources: list[str], least: int) -> dict[tuple, Category]:
    """Kept and pooled levels of every key and category, from one count."""
    if not sources:
        return {}
    pairs = F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).cast("string").alias("level")) for s in sources])
    counts = rows.select(key, F.inline(pairs)).groupBy(key, "source", "level").agg(F.count("*").alias("n"))
    kept = F.col("n") >= least
    # Kept levels come back by name, pooled ones as their number.
    counts = counts.groupBy(key, "source", F.when(kept, F.col("level")).alias("level")).agg(F.count("*").alias("many")).limit(MAX_COLUMNS * MAX_KEYS).collect()
    found: dict[tuple, Category] = {}
    for k, source in {(r[key], r["source"]) for r in counts}:
        own = [r for r in counts if (r[key], r["source"]) == (k, source)]
        levels = sorted(RARE if r["level"] is None else r["level"] for r in own)
        if len(levels) >= 2:
            pooled = sum(r["many"] for r in own if r["level"] is None)
            found[(k, source)] = Category(source, levels[0], levels[1:], pooled)
    return found


def fit_cox_by(
    df: DataFrame, key: str, covariates: list[str], categorical: list[str] = ["submarket", "season"],
    duration: str = DURATION, event: str = EVENT, ridge: float = 0.0, min_level: int = MIN_LEVEL, least: int = 2,
) -> dict:
    """A hazard fit for every level of ``key``: level to :class:`Fit`, or to the error it met.

    Each fit equals :func:`survival.fit_cox` of the key's rows alone; the number of jobs does not
    depend on the number of keys.  Rows with a null key are left out.
    """
    flag = col(event).cast("double")
    df = df.where(F.col(key).isNotNull())
    absent = [c for c in covariates if c not in df.columns]
    if absent:
        raise SchemaError(f"design columns absent from the frame: {absent}")
    # The rows are read several times; they are made once, with the columns the fits need.
    needed = [F.col(f"`{c}`") for c in dict.fromkeys([key, *covariates, duration, event])]
    usable_rows = land(df.where((col(duration) > 0) & flag.isin(0.0, 1.0)).select(*needed), "fits")
    categories = sorted(c for c in categorical if c in covariates)
    numeric = [c for c in covariates if c not in categories]
    usable = {c: F.col(c).cast("double").isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in numeric}
    usable |= {c: F.col(c).isNotNull() for c in categories}
    counts = _counts(usable_rows, key, usable, numeric)
    errors = {r[key]: f"listwise deletion left {r['__used']} rows" for r in counts if r["__used"] < least}
    keys = [r[key] for r in counts if r["__used"] >= least]
    if not keys:
        return errors
    number = F.coalesce(*[F.when(F.col(key) == F.lit(k), F.lit(i)) for i, k in enumerate(keys)])
    rows = usable_rows.withColumn("__k", number).where(F.col("__k").isNotNull() & all_of(usable.values()))
    found = _levels(rows, key, categories, min_level)
    union = [Term(c, c) for c in numeric]
    for source in categories:
        shown = sorted({v for k in keys if (k, source) in found for v in found[(k, source)].levels})
        union += [Term(f"{source}={v}", source, v) for v in shown]
    if len(union) >= MAX_COLUMNS:
        raise SchemaError(f"{len(union)} design columns exceed the limit of {MAX_COLUMNS}")
    level = {
        s: F.coalesce(*[F.when(F.col("__k") == i, found[(k, s)].value()) for i, k in enumerate(keys) if (k, s) in found] or [F.lit(None).cast("string")])
        for s in categories
    }
    rows = rows.withColumns({f"__level_{s}": v for s, v in level.items()})
    columns = {}
    for i, t in enumerate(union):
        value = F.col(t.source).cast("double") if t.level is None else F.coalesce((F.col(f"__level_{t.source}") == t.level).cast("double"), F.lit(0.0))
        columns[f"x{i}"] = value
    encoded = rows.select(
        F.col("__k").alias("fit"), F.lit(0.0).alias("stratum"), col(duration).cast("double").alias("t"), flag.alias("e"),
        *[v.alias(n) for n, v in columns.items()],
    )
    grams = keyed_grams(encoded, "fit", list(columns), len(keys))
    at = {t.name: i for i, t in enumerate(union)}
    designs, recipes = {}, {}
    by_key = {r[key]: r for r in counts}
    for i, k in enumerate(keys):
        own = {s: found[(k, s)] for s in categories if (k, s) in found}
        terms = [t for t in union if t.level is None or (t.source in own and t.level in own[t.source].levels)]
        row = by_key[k]
        design = Design(
            terms, own, null_counts={c: row[f"__null_{j}"] for j, c in enumerate(usable)}, rows_in=row["__rows"], rows_used=row["__used"],
        )
        for s in categories:
            if s not in own:
                design.notes.append(f"{s}: only one level present, dropped")
            elif own[s].pooled:
                design.notes.append(f"{s}: pooled {own[s].pooled} rare levels")
        moments = Gram([t.name for t in union], grams[i].matrix).pick([t.name for t in terms])
        try:
            settle_columns(design, moments, {c for j, c in enumerate(numeric) if row[f"__other_{j}"] == 0})
        except SchemaError as error:
            errors[k] = str(error)
            continue
        designs[i] = design
        recipes[i] = Recipe(
            np.array([at[n] for n in design.names]), np.array([design.means[n] for n in design.names]), np.array([design.scale[n] for n in design.names])
        )
    result: dict = dict(errors)
    if not recipes:
        return result
    layout = lay_out(encoded, list(columns), sum(by_key[k]["__used"] for k in keys))
    for i, optimum in maximise(Passes(layout, recipes), ridge).items():
        design, k = designs[i], keys[i]
        if optimum.error:
            result[k] = optimum.error
            continue
        scale = recipes[i].scale
        try:
            covariance = np.linalg.inv(optimum.information) / np.outer(scale, scale)
        except np.linalg.LinAlgError:
            result[k] = "singular information matrix"
            continue
        result[k] = Fit(
            "cox", design.names, optimum.point.beta / scale, covariance, design,
            int(round(optimum.point.rows)), int(round(optimum.point.events)),
            stats={"log_likelihood": optimum.point.value, "aic_partial": -2 * optimum.point.value + 2 * len(design.names)},
            notes=[*design.notes, *optimum.notes],
        )
    return result


SWEEP = "treatment string, rows bigint, events bigint, beta_price double, ci_low double, ci_high double, error string"


def sweep_table(spark, fits: dict, column: str = PRICE, order: list | None = None) -> DataFrame:
    """One row a key: rows, events, coefficient and interval, or the error."""
    out = []
    for k in order or sorted(fits, key=str):
        fit = fits.get(k, "no rows")
        if isinstance(fit, str):
            out.append((str(k), None, None, None, None, None, fit))
            continue
        own = fit.coefficient(column) or {"value": None, "ci_low": None, "ci_high": None}
        out.append((str(k), fit.rows, fit.events, own["value"], own["ci_low"], own["ci_high"], None))
    return spark.createDataFrame(out, SWEEP)


@dataclass
class Cell:
    """One cell of a comparison: which frame, and which column stands in for the price variable."""

    label: str
    frame: DataFrame
    variable: str


def fit_cells(cells: list[Cell], covariates: list[str], categorical: list[str] = ["submarket", "season"], least: int = 200, **names) -> dict:
    """The hazard model of every cell, in one run; a cell's variable takes the premium's place."""
    duration, event = names.get("duration", DURATION), names.get("event", EVENT)
    wanted = [c for c in covariates if c != PRICE]
    stacked = None
    # Cells of one frame are made in one reading of it.
    by_frame: dict[int, list[Cell]] = {}
    for cell in cells:
        if cell.variable in cell.frame.columns:
            by_frame.setdefault(id(cell.frame), []).append(cell)
    for own in by_frame.values():
        pairs = [F.struct(F.lit(c.label).alias("__cell"), F.col(c.variable).cast("double").alias("__variable")) for c in own]
        part = own[0].frame.select(
            F.col(duration).cast("double").alias(duration), F.col(event).cast("double").alias(event),
            *[F.col(c).cast("string" if c in categorical else "double").alias(c) for c in wanted], F.inline(F.array(*pairs)),
        ).withColumnRenamed("__variable", PRICE)
        stacked = part if stacked is None else stacked.unionByName(part)
    found = fit_cox_by(stacked, "__cell", [PRICE, *wanted], categorical, duration, event, least=least) if stacked is not None else {}
    return {c.label: found.get(c.label, f"{c.variable} absent" if c.variable not in c.frame.columns else "no usable rows") for c in cells}
