"""Queries that read a few columns of the export make only those."""

import datetime

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from tidemark.operators import clean, normalize
from tidemark.plans import catalog, check_normalize, stand_ins
from tidemark.session import METHOD_LIMIT, METHOD_LIMIT_KEY


def test_readers_of_few_export_columns_do_not_write_the_export(spark, tmp_path):
    day, n = datetime.date(2020, 1, 1), 400
    number = np.arange(n)
    tables = {
        "lineitem": pd.DataFrame(
            {
                "l_orderkey": number // 4, "l_linenumber": (number % 4 + 1).astype("int32"), "l_partkey": number % 50, "l_suppkey": number % 7,
                "l_shipdate": [day + datetime.timedelta(days=int(i % 90)) for i in number], "l_extendedprice": 900.0 + 37 * number,
                "l_discount": 0.05, "l_quantity": (number % 50 + 1).astype(float),
            }
        ),
        "orders": pd.DataFrame({"o_orderkey": np.arange(n // 4), "o_orderdate": day}),
        "part": pd.DataFrame({"p_partkey": np.arange(50), "p_size": np.arange(50, dtype="int32"), "p_name": "red blue", "p_brand": "Brand#11"}),
    }
    for name, table in tables.items():
        spark.createDataFrame(table).write.parquet(f"{tmp_path}/{name}.parquet")
    folder = str(tmp_path)
    names = ("nrm_money_area_zip", "nrm_parse_floor")
    direct = [sorted(check_normalize.QUERIES[q](spark, folder).collect(), key=str) for q in names]
    assert not any(folder in key for key in stand_ins._LANDED)
    assert int(spark.conf.get(METHOD_LIMIT_KEY)) <= METHOD_LIMIT
    stand_ins.raw_export(spark, folder)
    assert any(folder in key for key in stand_ins._LANDED)
    assert [sorted(check_normalize.QUERIES[q](spark, folder).collect(), key=str) for q in names] == direct
    assert len(direct[0]) == n


def test_readers_of_few_listing_columns_do_not_write_the_listings(spark, tmp_path):
    day, n = datetime.date(2020, 1, 1), 600
    # Ids come up to three times; among them lines that only the quantity tells apart, and equal ones.
    number = np.array([*range(n), *range(0, n, 9), *range(0, n, 18)])
    tables = {
        "lineitem": pd.DataFrame(
            {
                "l_orderkey": number // 4, "l_linenumber": (number % 4 + 1).astype("int32"), "l_partkey": number % 50, "l_suppkey": number % 7,
                "l_shipdate": [day + datetime.timedelta(days=int(i % 90)) for i in number], "l_extendedprice": 9000.0 + 37 * number,
                "l_discount": 0.05, "l_quantity": np.where(np.arange(len(number)) < n, 10.0, 20.0),
            }
        ),
        "orders": pd.DataFrame({"o_orderkey": np.arange(n // 4), "o_orderdate": [day + datetime.timedelta(days=int(i)) for i in range(n // 4)]}),
        "part": pd.DataFrame({"p_partkey": np.arange(50), "p_size": np.arange(50, dtype="int32"), "p_name": "red blue", "p_brand": "Brand#11"}),
        "nation": pd.DataFrame({"n_nationkey": np.arange(25, dtype="int32"), "n_name": [f"NATION_{i}" for i in range(25)]}),
    }
    for name, table in tables.items():
        spark.createDataFrame(table).write.parquet(f"{tmp_path}/{name}.parquet")
    folder, found = str(tmp_path), catalog.queries()
    names = (
        "nrm_duration_event", "nrm_unit_floor", "nrm_cancelled_choices", "aud_start_cohorts", "aud_anchor_scores", "aud_column_ratio",
        "cln_waterfall", "cln_excluded", "cln_rows", "cln_counts", "agg_value_counts", "agg_null_profile", "agg_identification",
        "agg_covariate_gaps", "agg_feature_flags", "ft_row_features", "aud_edge_censoring", "set_dropped_reasons",
    )
    direct = {q: sorted(map(str, found[q](spark, folder).collect())) for q in names}
    written = {key[1] for key in stand_ins._LANDED if folder in key}
    assert not written & {"export", "listings", "cleaned"}, written
    stand_ins.normalized(spark, folder)
    stand_ins.cleaned(spark, folder)
    assert {key[1] for key in stand_ins._LANDED if folder in key} >= {"listings", "cleaned"}
    for q in names:
        assert sorted(map(str, found[q](spark, folder).collect())) == direct[q], q
    assert len(direct["nrm_duration_event"]) == len(number)
    assert any("duplicate_mls_number" in row for row in direct["cln_waterfall"])


def test_ties_are_told_apart_by_the_whole_row(spark):
    rows = [(i // 4, 1, i % 4 // 2, f"v{i}") for i in range(40)] + [(90, 1, 1, "same")] * 3 + [(None, 1, 1, "x")] * 2
    table = spark.createDataFrame(rows, "id int, at int, part int, text string").withColumn("more", F.create_map(F.lit("k"), F.col("text")))
    whole = clean.mark_duplicates(table, "id", ["at"], F.lit(True))
    few = clean.mark_duplicates(table.drop("text", "more"), "id", ["at"], F.lit(True), table)
    assert few.columns == ["id", "at", "part", "_duplicate"]
    expected = sorted(map(str, whole.select(few.columns).collect()))
    assert sorted(map(str, few.collect())) == expected
    kept = [r for r in whole.collect() if not r["_duplicate"]]
    assert len(kept) == 10 + 1 + 2 and whole.count() == len(rows)


def test_the_day_of_an_export_is_read_from_the_first_column_that_has_one(spark):
    frame = spark.createDataFrame([(None, datetime.date(2020, 5, 1)), (None, datetime.date(2021, 5, 1))], "a date, b date")
    assert normalize.export_snapshot(frame, ("a", "b")) == datetime.date(2021, 5, 1)
    assert normalize.export_snapshot(frame, ("b", "a")) == datetime.date(2021, 5, 1)
    assert normalize.export_snapshot(frame, ("a",)) is None
