"""Operators that go over their rows many times make them once."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import absorb, audit, logit, survival


def counted(spark, pdf):
    """The rows, and a count of how many of them were made."""
    made = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    plain = spark.createDataFrame(pdf)
    return plain.mapInPandas(note, plain.schema), made


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    n = 1_200
    x = rng.normal(size=n)
    return pd.DataFrame(
        {
            "rel_price_premium": x, "other": rng.normal(size=n), "place": rng.integers(0, 9, n), "p": rng.random(n),
            "duration_days": np.ceil(rng.exponential(60 * np.exp(x))), "event_sold": rng.integers(0, 2, n), "y": x + rng.normal(size=n),
        }
    )


def test_hazard_fit_makes_its_rows_once(spark, rows):
    for strata in (None, "place"):
        frame, made = counted(spark, rows)
        fit = survival.fit_cox(frame, ["rel_price_premium"], [], with_concordance=False, strata=strata)
        fit.baseline_table(spark).collect()
        assert fit.fit.rows == len(rows) and made.value == len(rows)


def test_cells_of_a_frame_make_its_rows_once(spark, rows):
    frame, made = counted(spark, rows)
    other, more = counted(spark, rows[:900])
    found = audit.decompose_change(other, frame, "rel_price_premium", "other", ["rel_price_premium"], [])
    got = {r["part"]: r["value"] for r in found.collect()}
    assert (made.value, more.value) == (len(rows), 900)
    one = survival.fit_cox(spark.createDataFrame(rows), ["rel_price_premium"], [], with_concordance=False).fit.values[0]
    assert abs(got["new data, old variable"] - one) < 1e-8


def test_absorbing_makes_its_rows_once(spark, rows):
    frame, made = counted(spark, rows)
    found = absorb.absorbed_least_squares("close", frame, ["rel_price_premium", "other"], "y", ["place"])
    assert found.effects.count() == 9 and made.value == len(rows)


def test_calibration_makes_its_rows_once(spark, rows):
    frame, made = counted(spark, rows)
    assert sum(r["n"] for r in logit.calibration(frame, "p", "event_sold").collect()) == len(rows)
    assert made.value == len(rows)
