import duckdb
import pytest

from check import TABLES, rows_of
from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "ft_cell_median_premium", "nrm_unit_floor", "nrm_list_date", "cln_waterfall", "cln_rows", "ft_row_features",
    "win_status_runs", "cube_revenue", "plan_violations", "scn_revenue", "mac_dispersion", "reg_logit",
]


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_flagship(spark):
    frame = entry(spark)
    assert frame.count() > 0 and "rel_price_premium" in frame.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = queries()[name](spark, FOLDER)
    cursor = con.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(names, cursor.fetchall())
