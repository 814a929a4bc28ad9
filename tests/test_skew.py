"""Operators where one group holds most of the rows take another way; the answer is the same."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, clean, concordance, quantiles, sampling
from tidemark.operators.quantiles import grouped_middle, grouped_quantiles


def skewed(spark, n=60_000, seed=3):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b", "c"], n))
    value = np.where(rng.random(n) < 0.3, 5.0, rng.lognormal(size=n).round(4))
    pdf = pd.DataFrame({"k": key, "v": value})
    return spark.createDataFrame(pdf), pdf


def test_quantiles_of_a_hot_group(spark):
    frame, pdf = skewed(spark)
    wanted = {"p5": 0.05, "p50": 0.5, "p99": 0.99, "low": 0.0, "high": 1.0}
    got = {r["k"]: r for r in grouped_quantiles(frame, ["k"], "v", wanted, "n", max_group=2_000).collect()}
    for k, group in pdf.groupby("k"):
        assert got[k]["n"] == len(group)
        for name, p in wanted.items():
            assert abs(got[k][name] - group["v"].quantile(p)) < 1e-9
    whole = grouped_quantiles(frame, [], "v", wanted, max_group=2_000).first()
    assert abs(whole["p50"] - pdf["v"].median()) < 1e-9


def test_quantiles_of_a_hot_group_without_a_key(spark):
    frame, pdf = skewed(spark)
    rows = frame.withColumn("k", F.when(F.col("k") != "hot", F.col("k")))
    got = {r["k"]: r for r in grouped_quantiles(rows, ["k"], "v", {"p50": 0.5, "p99": 0.99}, "n", max_group=2_000).collect()}
    hot = pdf[pdf["k"] == "hot"]["v"]
    assert got[None]["n"] == len(hot) and len(got) == 4
    assert abs(got[None]["p50"] - hot.median()) < 1e-9 and abs(got[None]["p99"] - hot.quantile(0.99)) < 1e-9


def test_one_row_of_each_id_stays(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 5, "w"), ("b", 5, "w"), (None, 1, "n"), (None, 1, "n")]
    frame = spark.createDataFrame(rows, "id string, at int, t string")
    kept = clean.mark_duplicates(frame, "id", ["at"], F.lit(True)).where(~F.col("_duplicate")).collect()
    assert sorted(r["id"] or "" for r in kept) == ["", "", "a", "b"]


def test_a_missed_bracket_is_widened(spark, monkeypatch):
    frame, pdf = skewed(spark, 50_000)
    monkeypatch.setattr(quantiles, "BRACKET", 1e-9)
    got = grouped_quantiles(frame, ["k"], "v", {"p50": 0.5}, "n", max_group=2_000)
    assert abs({r["k"]: r["p50"] for r in got.collect()}["hot"] - pdf[pdf["k"] == "hot"]["v"].median()) < 1e-9


def test_middle_of_a_hot_group(spark):
    frame, pdf = skewed(spark, 40_001)
    a = sorted(map(tuple, grouped_middle(frame, ["k"], "v").collect()))
    b = sorted(map(tuple, grouped_middle(frame, ["k"], "v", max_group=500).collect()))
    assert a == b


def test_leave_one_out_median(spark):
    frame, pdf = skewed(spark, 300)
    rows = audit.leave_one_out_median(frame, ["k"], "v", least=2)
    got = {(r["k"], r["v"]): r["loo_median"] for r in rows.collect()}
    for (k, v), found in got.items():
        others = pdf[pdf["k"] == k]["v"].tolist()
        others.remove(v)
        assert found is None and not others or abs(found - np.median(others)) < 1e-12


@pytest.mark.parametrize("base, strata", [(4, None), (256, None), (4, "g")])
def test_concordance_by_digits_equals_brute_force(spark, monkeypatch, base, strata):
    rng = np.random.default_rng(5)
    n = 600
    score, day, event = rng.normal(size=n).round(1), rng.integers(1, 40, n), rng.integers(0, 2, n)
    level = rng.integers(0, 5, n) if strata else np.zeros(n, int)
    frame = spark.createDataFrame(pd.DataFrame({"s": score, "d": day.astype(float), "e": event, "g": level}))
    c = d = t = 0
    for i in np.flatnonzero(event):
        later = ((day > day[i]) | ((day == day[i]) & (event == 0))) & (level == level[i])
        c += (score[i] > score[later]).sum()
        d += (score[i] < score[later]).sum()
        t += (score[i] == score[later]).sum()
    monkeypatch.setattr(concordance, "BASE", base)  # so scores have several digits
    monkeypatch.setattr(concordance, "LEAST_ROWS", 100)
    monkeypatch.setattr(concordance, "CELLS_AT_ONCE", 7)
    got = concordance.concordance(frame, "s", "d", "e", strata)
    assert (got["concordant"], got["discordant"], got["tied"]) == (c, d, t)


def test_ks_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(concordance, "LEAST_ROWS", 100)
    frame, pdf = skewed(spark, 3_000)
    hot = pdf["k"] == "hot"
    points = np.sort(pdf["v"].unique())
    a = np.searchsorted(np.sort(pdf["v"][hot]), points, side="right") / hot.sum()
    b = np.searchsorted(np.sort(pdf["v"][~hot]), points, side="right") / (~hot).sum()
    row = audit.kolmogorov_smirnov(frame, F.col("k") == "hot", "v").first()
    assert abs(row["d"] - np.abs(a - b).max()) < 1e-12


def test_runs_across_pieces(spark):
    labels = list("aaabbaaaaccca")
    rows = [("f", i // 4, i, v) for i, v in enumerate(labels)]
    frame = spark.createDataFrame(rows, "file string, piece int, i int, v string").repartition(3)
    got = sorted((r["run"], r["value"], r["rows"]) for r in sampling.runs(frame, ["file"], "piece", ["i"], "v").collect())
    assert [(v, n) for _, v, n in got] == [("a", 3), ("b", 2), ("a", 4), ("c", 3), ("a", 1)]


def test_extreme_rows_over_several_batches(spark):
    # One task reads more rows than one batch holds: kept rows meet the next batch.
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 25_000), "v": rng.integers(0, 900, 25_000).astype(float), "i": np.arange(25_000), "more": rng.normal(size=25_000)})
    frame = spark.createDataFrame(pdf).coalesce(1)
    got = {(r["k"], r["side"], r["rank"]): (r["ident"], r["value"], r["more"]) for r in audit.extreme_rows(frame, ["k"], "v", "i", 4, ["more"]).collect()}
    wanted = {}
    for k, group in pdf.groupby("k"):
        for side, up in (("low", True), ("high", False)):
            ends = group.sort_values(["v", "i"], ascending=[up, True]).head(4)
            wanted |= {(k, side, n): (r.i, r.v, r.more) for n, r in enumerate(ends.itertuples(), 1)}
    assert got == wanted
    whole = audit.extreme_rows(frame, [], "v", "i", 2).orderBy("side", "rank").collect()
    assert [r["ident"] for r in whole] == [*pdf.sort_values(["v", "i"], ascending=[False, True])["i"][:2], *pdf.sort_values(["v", "i"])["i"][:2]]
