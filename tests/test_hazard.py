"""Hazard fits over many partitions, strata, replicates and keys against dense arithmetic."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.errors import SchemaError
from tidemark.operators import absorb, bootstrap, hazard, hedonic, keyed, survival


def dense(x, day, event, stratum=None, weight=None, steps=9):
    """Newton with Efron ties, one risk set at a time; likelihood added over strata."""
    stratum = np.zeros(len(day), int) if stratum is None else stratum
    weight = np.ones(len(day)) if weight is None else weight
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        gradient, information = np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
        for s in np.unique(stratum[event == 1]):
            own = stratum == s
            xs, ds, es, ws = x[own], day[own], event[own], weight[own]
            w = ws * np.exp(xs @ beta)
            for t in np.unique(ds[(es == 1) & (ws > 0)]):
                risk, dies = ds >= t, (ds == t) & (es == 1)
                m = int(round(ws[dies].sum()))
                gradient += ws[dies] @ xs[dies]
                for k in range(m):
                    v = w * risk - k / m * w * dies
                    s0, s1 = v.sum(), v @ xs
                    gradient -= s1 / s0
                    information += (xs.T * v) @ xs / s0 - np.outer(s1, s1) / s0**2
        beta = beta + np.linalg.solve(information, gradient)
    return beta, np.sqrt(np.diag(np.linalg.inv(information)))


def spells(n, levels, seed=3, days=60, beta=(-1.2, 0.5)):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [0.4, 1.0]
    level = rng.integers(0, levels, n)
    base = 0.02 * np.exp(rng.normal(size=levels))[level]
    clock = np.ceil(rng.exponential(1 / (base * np.exp(x @ beta))))
    limit = rng.integers(1, days, n)
    return pd.DataFrame(
        {
            "row_id": np.arange(n), "rel_price_premium": x[:, 0], "size": x[:, 1], "building_name": [f"b{v}" for v in level],
            "duration_days": np.minimum(clock, limit), "event_sold": (clock <= limit).astype(int),
        }
    )


def columns(pdf):
    return pdf[["rel_price_premium", "size"]].to_numpy(), pdf["duration_days"].to_numpy(), pdf["event_sold"].to_numpy()


@pytest.fixture
def thin(monkeypatch):
    """Partitions of a few rows, so cells, strata and days lie across many of them."""
    monkeypatch.setattr(hazard, "LEAST_ROWS", 40)
    monkeypatch.setattr(hazard, "PART_BYTES", 48 * 60)


@pytest.mark.parametrize("days", [6, 400])
def test_many_partitions_equal_dense(spark, thin, days):
    pdf = spells(900, 1, days=days)
    fit = survival.fit_cox(spark.createDataFrame(pdf), ["rel_price_premium", "size"], [], with_concordance=False)
    beta, errors = dense(*columns(pdf))
    assert np.allclose(fit.fit.values, beta, atol=1e-7)
    assert np.allclose(np.sqrt(np.diag(fit.fit.covariance)), errors, rtol=1e-6)
    # Breslow's baseline, cell by cell.
    x, day, event = columns(pdf)
    w = np.exp((x - x.mean(axis=0)) @ fit.fit.values)
    table = {r["t"]: r for r in fit.baseline_table().collect()}
    assert sorted(table) == sorted(np.unique(day))
    total = 0.0
    for t in sorted(table):
        total += event[day == t].sum() / w[day >= t].sum()
        assert abs(table[t]["cumulative"] - total) < 1e-9
    grid = [0.5, 3.0, 7.25, 1e6]
    held = fit.cumulative_at(grid), fit.survival_at(grid)
    fit.held = None
    assert np.allclose(fit.cumulative_at(grid), held[0]) and np.allclose(fit.survival_at(grid), held[1])


@pytest.mark.parametrize("n, levels", [(900, 60), (600, 3)])
def test_strata_equal_dense(spark, thin, n, levels):
    pdf = spells(n, levels)
    frame = spark.createDataFrame(pdf)
    fit = survival.fit_cox(frame, ["rel_price_premium", "size"], [], strata="building_name")
    x, day, event = columns(pdf)
    level = pdf["building_name"].to_numpy()
    beta, errors = dense(x, day, event, level)
    assert np.allclose(fit.fit.values, beta, atol=1e-7)
    assert np.allclose(np.sqrt(np.diag(fit.fit.covariance)), errors, rtol=1e-6)
    assert 0.5 < fit.fit.stats["concordance"] < 1 and fit.fit.stats["strata"] == len(set(level))
    got = {r["row_id"]: r["probability"] for r in fit.with_probability(frame, 20).collect()}
    w = np.exp((x - x.mean(axis=0)) @ fit.fit.values)
    for i in range(0, n, 97):
        own = level == level[i]
        steps = [(t, event[own & (day == t)].sum() / w[own & (day >= t)].sum()) for t in np.unique(day[own])]
        grid, total = np.array([0.0, *[t for t, _ in steps]]), np.cumsum([0.0, *[h for _, h in steps]])
        assert abs(got[i] - (1 - np.exp(-np.interp(20, grid, total) * w[i]))) < 1e-9


def test_three_thousand_strata_and_a_planted_slope(spark):
    pdf = spells(40_000, 3_000, seed=8)
    pdf.loc[:4, "building_name"] = None
    fit = survival.fit_cox(spark.createDataFrame(pdf), ["rel_price_premium", "size"], [], strata="building_name", with_concordance=False)
    found = fit.fit.coefficient("rel_price_premium")
    assert found["ci_low"] < -1.2 < found["ci_high"] and found["std_error"] < 0.05
    assert fit.fit.rows == len(pdf) - 5 and fit.fit.stats["strata"] == pdf["building_name"].nunique()
    with pytest.raises(SchemaError):
        fit.probability(30)


def test_a_million_distinct_durations(spark):
    rng = np.random.default_rng(1)
    n = 1_000_000
    x = rng.normal(size=n)
    clock = rng.exponential(np.exp(0.7 * x))
    pdf = pd.DataFrame({"x": x, "duration_days": np.minimum(clock, 2.0) + np.arange(n) * 1e-12, "event_sold": (clock < 2.0).astype(int)})
    fit = survival.fit_cox(spark.createDataFrame(pdf), ["x"], [], with_concordance=False)
    # Without ties the sums are suffix sums of the sorted rows.
    order = np.argsort(pdf["duration_days"].to_numpy())
    z, e, beta = x[order], pdf["event_sold"].to_numpy()[order], 0.0
    for _ in range(8):
        w = np.exp(beta * z)
        s0, s1, s2 = (np.cumsum((w * z**k)[::-1])[::-1] for k in range(3))
        mean = s1 / s0
        beta += (e @ (z - mean)) / (e @ (s2 / s0 - mean**2))
    assert abs(fit.fit.values[0] - beta) < 1e-8
    assert fit.cells.count() == n and fit.held is None
    total = np.cumsum(e / np.cumsum(np.exp(beta * (z - x.mean()))[::-1])[::-1])
    day = pdf["duration_days"].to_numpy()[order]
    assert np.allclose(fit.cumulative_at([0.3, 1.1]), np.interp([0.3, 1.1], day, total), rtol=1e-6)


def test_replicates_equal_single_refits(spark, thin):
    pdf = spells(700, 4, seed=9)
    pdf["list_ppsf"] = np.exp(6 + pdf["rel_price_premium"] + 0.1 * pdf["size"])
    frame = spark.createDataFrame(pdf)
    premium = hedonic.fit_premium(frame, numeric=["size"], categorical=["building_name"])
    cox = survival.fit_cox(frame, ["rel_price_premium", "size"], [], with_concordance=False)
    found = bootstrap.bootstrap_price(frame, cox, premium, ["row_id"], replicates=4)
    assert found.failures == 0
    weights = {r["row_id"]: r["w"] for r in frame.select("row_id", bootstrap.replicate_weights(["row_id"], 4).alias("w")).collect()}
    w = np.array([weights[i] for i in pdf["row_id"]])
    _, day, event = columns(pdf)
    z = np.column_stack([np.ones(len(pdf)), pdf["size"], *[pdf["building_name"] == f"b{i}" for i in range(1, 4)]]).astype(float)
    y = np.log(pdf["list_ppsf"].to_numpy())
    for r, draw in enumerate(found.draws):
        root = np.sqrt(w[:, r])
        slopes = np.linalg.lstsq(z * root[:, None], y * root, rcond=None)[0]
        x = np.column_stack([np.expm1(y - z @ slopes), pdf["size"]])
        own = w[:, r] > 0
        beta, _ = dense(x[own], day[own], event[own], weight=w[own, r])
        assert abs(draw - beta[0]) < 1e-6


def test_keyed_fits_equal_fits_of_the_keys_rows(spark, thin):
    parts = []
    for i, k in enumerate(["a", "b", "c"]):
        part = spells(500 + 50 * i, 7, seed=20 + i).assign(key=k)
        part["view"] = np.where(part["row_id"] % (3 + i) == 0, "sea", np.where(part["row_id"] % 97 == 0, f"rare{k}", "city"))
        part.loc[part["row_id"] % 41 == 0, "size"] = None
        parts.append(part)
    flat = spells(60, 2, seed=31).assign(key="flat", view="city", rel_price_premium=0.5, size=1.0)
    few = spells(40, 2, seed=32).assign(key="none", view="sea", event_sold=0)
    pdf = pd.concat([*parts, flat, few, spells(5, 1).assign(key=None, view="sea")], ignore_index=True)
    frame = spark.createDataFrame(pdf)
    names = ["rel_price_premium", "size", "view"]
    found = keyed.fit_cox_by(frame, "key", names, ["view"], min_level=20)
    assert sorted(found) == ["a", "b", "c", "flat", "none"]
    assert found["flat"] == "every design column was constant" and "two events" in found["none"]
    for k in "abc":
        alone = survival.fit_cox(frame.where(F.col("key") == k), names, ["view"], min_level=20, with_concordance=False).fit
        assert found[k].names == alone.names and (found[k].rows, found[k].events) == (alone.rows, alone.events)
        assert np.allclose(found[k].values, alone.values, atol=1e-8) and np.allclose(found[k].covariance, alone.covariance, rtol=1e-6)
    table = {r["treatment"]: r for r in keyed.sweep_table(spark, found).collect()}
    assert table["none"]["error"] and table["a"]["beta_price"] == found["a"].coefficient("rel_price_premium")["value"]


def test_two_by_two_cells(spark):
    old, new = (spark.createDataFrame(spells(400 + 100 * i, 3, seed=40 + i)).withColumn("other", F.col("rel_price_premium") + F.col("size") / 4) for i in range(2))
    cells = [keyed.Cell(f"{d}/{v}", f, v) for d, f in (("old", old), ("new", new)) for v in ("rel_price_premium", "other", "gone")]
    found = keyed.fit_cells(cells, ["rel_price_premium", "size"], [], least=200)
    alone = survival.fit_cox(new.withColumn("rel_price_premium", F.col("other")), ["rel_price_premium", "size"], [], with_concordance=False).fit
    assert abs(found["new/other"].coefficient("rel_price_premium")["value"] - alone.coefficient("rel_price_premium")["value"]) < 1e-8
    assert found["old/gone"] == "gone absent"


def test_one_absorbed_factor_with_many_levels(spark):
    rng = np.random.default_rng(2)
    n, levels = 200_000, 50_000
    level = rng.integers(0, levels, n)
    effect = rng.normal(size=levels)[level]
    x = np.column_stack([rng.normal(size=n) + effect, rng.normal(size=n) * 100 + 1e4])
    y = 2 * x[:, 0] - 0.01 * x[:, 1] + 3 * effect + rng.normal(size=n)
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "age": (level % 80).astype(float), "y": y, "building": level})
    fit = absorb.absorbed_least_squares("close", spark.createDataFrame(pdf), ["a", "b", "age"], "y", ["building"])
    mean = pdf.groupby("building")[["a", "b", "y"]].transform("mean").to_numpy()
    z, v = x - mean[:, :2], y - mean[:, 2]
    beta = np.linalg.lstsq(z, v, rcond=None)[0]
    used = len(np.unique(level))
    variance = ((v - z @ beta) ** 2).sum() / (n - 2 - used)
    assert fit.fit.names == ["a", "b"] and fit.fit.stats["levels"] == used
    assert np.allclose(fit.fit.values, beta, rtol=1e-8)
    assert np.allclose(fit.fit.covariance, variance * np.linalg.inv(z.T @ z), rtol=1e-6)
    some = fit.with_prediction(spark.createDataFrame(pdf.head(50)), 2 * F.lit(0.0) + fit.fit.values[0] * F.col("a") + fit.fit.values[1] * F.col("b")).toPandas()
    want = mean[:50, 2] + z[:50] @ beta
    assert np.allclose(some.sort_values(["a"])["predicted"], want[np.argsort(pdf["a"].to_numpy()[:50])], rtol=1e-8)


def test_two_absorbed_factors_equal_columns(spark):
    rng = np.random.default_rng(6)
    n = 600
    one, other = rng.integers(0, 25, n), rng.integers(0, 12, n)
    other[one < 5], other[one >= 5] = other[one < 5] % 4, 4 + other[one >= 5] % 8  # two groups that nothing links
    x = rng.normal(size=(n, 2)) + one[:, None] / 9
    y = x @ [1.5, -0.7] + one + np.sqrt(other) + rng.normal(size=n)
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y, "one": one, "other": other})
    fit = absorb.absorbed_least_squares("close", spark.createDataFrame(pdf), ["a", "b"], "y", ["one", "other"])
    full = np.column_stack([x, pd.get_dummies(one), pd.get_dummies(other)]).astype(float)
    beta, _, rank, _ = np.linalg.lstsq(full, y, rcond=None)
    assert fit.fit.stats["levels"] == rank - 2 and fit.fit.freedom == n - rank
    assert np.allclose(fit.fit.values, beta[:2], atol=1e-7)
    spare = ((y - full @ beta) ** 2).sum() / (n - rank)
    assert abs(fit.fit.stats["residual_sd"] - np.sqrt(spare)) < 1e-7
