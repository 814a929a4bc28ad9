import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.errors import SchemaError
from tidemark.functions.distributions import chi_square_p, t_p, t_quantile
from tidemark.operators import bootstrap, cube, diagnostics, hazard, hedonic, logit, survival
from tidemark.operators.gram import Gram, dependent_columns, gram, least_squares


def spells(n=2_500, beta=-1.6, seed=1):
    rng = np.random.default_rng(seed)
    x, group = rng.normal(size=n) * 0.3, rng.integers(0, 3, n)
    clock = np.ceil(rng.exponential(1 / (0.006 * np.exp(beta * x + 0.4 * (group == 1)))))
    limit = rng.integers(30, 400, n)
    return pd.DataFrame(
        {
            "row_id": np.arange(n), "rel_price_premium": x, "group": np.array(["a", "b", "c"])[group],
            "duration_days": np.minimum(clock, limit), "event_sold": (clock <= limit).astype(int),
        }
    )


@pytest.fixture(scope="module")
def fitted(spark):
    pdf = spells()
    frame = spark.createDataFrame(pdf)
    return pdf, frame, survival.fit_cox(frame, ["rel_price_premium", "group"], ["group"])


def dense_cox(pdf):
    x = np.column_stack([pdf["rel_price_premium"], pdf["group"] == "b", pdf["group"] == "c"]).astype(float)
    day, event = pdf["duration_days"].to_numpy(), pdf["event_sold"].to_numpy()
    beta = np.zeros(3)
    for _ in range(8):
        gradient, information = np.zeros(3), np.zeros((3, 3))
        w = np.exp(x @ beta)
        for t in np.unique(day[event == 1]):
            at_risk, dies = day >= t, (day == t) & (event == 1)
            gradient += x[dies].sum(axis=0)
            for k in range(dies.sum()):
                v = w * at_risk - k / dies.sum() * w * dies
                s0, s1 = v.sum(), v @ x
                gradient -= s1 / s0
                information += (x.T * v) @ x / s0 - np.outer(s1, s1) / s0**2
        beta = beta + np.linalg.solve(information, gradient)
    return beta, np.sqrt(np.diag(np.linalg.inv(information)))


def test_cox_equals_dense_arithmetic(fitted):
    pdf, _, cox = fitted
    beta, errors = dense_cox(pdf)
    assert np.allclose(cox.fit.values, beta, atol=1e-6)
    assert np.allclose(np.sqrt(np.diag(cox.fit.covariance)), errors, rtol=1e-5)


def test_planted_coefficient_is_recovered(fitted):
    _, _, cox = fitted
    found = cox.fit.coefficient("rel_price_premium")
    assert found["ci_low"] < -1.6 < found["ci_high"]


def test_probability_falls_with_price(spark, fitted):
    _, frame, cox = fitted
    rows = frame.limit(1).withColumn("rel_price_premium", F.explode(F.array(*[F.lit(v / 10) for v in range(-5, 6)])))
    p = [r[0] for r in rows.orderBy("rel_price_premium").select(cox.probability(180)).collect()]
    assert all(a > b for a, b in zip(p, p[1:])) and 0 < p[-1] < p[0] < 1
    with pytest.raises(SchemaError):
        cox.probability(0)


def test_hazard_residuals_do_not_alarm(fitted):
    _, frame, cox = fitted
    rows = {r["name"]: r["p_value"] for r in survival.day_residuals(frame, cox).collect()}
    assert rows["rel_price_premium"] > 0.001


def test_tie_sums_in_pieces_equal_those_at_once(monkeypatch):
    cells = [45_000.0, 20.0, 900.0], [36_000.0, 3.0, 700.0], [15_000, 0, 350]
    exact = hazard.tie_sums(*cells)
    share = np.arange(15_000) / 15_000
    assert np.isclose(exact[0, 0], (1 / (45_000 - share * 36_000)).sum()) and not exact[1].any()
    monkeypatch.setattr(hazard, "TIES_AT_ONCE", 1_000)
    assert np.allclose(hazard.tie_sums(*cells), exact, rtol=1e-9)


def test_exponential_agrees_with_cox(fitted):
    _, frame, cox = fitted
    fit = logit.fit_exponential(frame, ["rel_price_premium"], "duration_days", "event_sold")
    assert abs(fit.coefficient("rel_price_premium")["value"] - cox.fit.coefficient("rel_price_premium")["value"]) < 0.15


def test_diagnosis(fitted):
    _, frame, cox = fitted
    found = diagnostics.diagnose(frame, cox.fit)
    assert found.status == "WARN"
    diagnostics.require_pass(found)


def test_bootstrap(spark):
    pdf = spells(600, seed=9)
    pdf["list_ppsf"] = np.exp(6 + pdf["rel_price_premium"])
    frame = spark.createDataFrame(pdf)
    cox = survival.fit_cox(frame, ["rel_price_premium"], [], with_concordance=False)
    premium = hedonic.fit_premium(frame, numeric=[], categorical=["group"])
    found = bootstrap.bootstrap_price(frame, cox, premium, ["row_id"], replicates=3)
    assert found.failures == 0 and len(set(found.draws)) == 3 and 0 < found.se < 1


def test_gram_native_and_python_agree(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 14))
    x[:, 13] = x[:, 0] + x[:, 1]
    names = [f"c{i}" for i in range(14)]
    frame = spark.createDataFrame(pd.DataFrame(x, columns=names))
    full = gram(frame, names)
    z = np.column_stack([np.ones(500), x])
    assert np.allclose(full.matrix, z.T @ z)
    assert np.allclose(gram(frame, names[:5]).matrix, full.pick(names[:5]).matrix)
    assert len(dependent_columns(full)) == 1
    fit = least_squares(full, "c13", ["c0", "c1"])
    assert np.allclose(fit.values, [0, 1, 1], atol=1e-9) and fit.r_squared > 1 - 1e-9


def test_least_squares_errors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2, -1] + rng.normal(size=200)
    z = np.column_stack([np.ones(200), x, y])
    fit = least_squares(Gram(["a", "b", "y"], z.T @ z), "y", ["a", "b"])
    w = z[:, :3]
    beta = np.linalg.lstsq(w, y, rcond=None)[0]
    variance = ((y - w @ beta) ** 2).sum() / 197
    assert np.allclose(fit.values, beta) and np.allclose(fit.covariance, variance * np.linalg.inv(w.T @ w))


def test_distributions():
    assert abs(t_p(2.0, 10) - 0.0733880) < 1e-6
    assert abs(t_quantile(0.95, 10) - 2.2281389) < 1e-6
    assert abs(chi_square_p(3.841459, 1) - 0.05) < 1e-6


def test_arrival_discount_lies_between_horizon_and_release(spark):
    days = cube.arrival_grid(180, None)
    survival_curve = np.exp(-0.004 * days)
    frame = spark.createDataFrame([(0.3, 6.0), (0.9, 6.0), (0.0, 6.0)], "p double, m double")
    got = [r[0] for r in frame.select(cube.arrival_factor(F.col("p"), "m", 0.12, survival_curve, days)).collect()]
    release, horizon = 1.12 ** (-0.5), 1.12 ** (-(6 + 180 / 30.4375) / 12)
    assert horizon < got[0] < got[1] < release and math.isclose(got[2], release)
