"""A whole fit over the smallest tables, written and read back."""

import pytest

from tidemark.errors import SchemaError
from tidemark.operators import features
from tidemark.plans import fit_demand, stand_ins

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return features.build_features(stand_ins.cleaned(spark, FOLDER).frame)


def test_a_fit_on_real_data_has_to_be_asked_for(table):
    with pytest.raises(SchemaError):
        fit_demand.fit_demand(table, real_data=True)


def test_fit_is_saved_and_read_back(spark, table, tmp_path):
    fit = fit_demand.fit_demand(table, real_data=False, controls=False)
    paths = fit_demand.save(fit, str(tmp_path))
    tables = fit.tables(spark)
    assert set(paths) == set(tables)
    for name, path in paths.items():
        back = spark.read.parquet(path)
        assert back.columns == tables[name].columns and sorted(map(str, back.collect())) == sorted(map(str, tables[name].collect())), name
    read = {r["name"]: r["value"] for r in spark.read.parquet(paths["cox_coefficients"]).collect()}
    assert read == fit.cox.fit.lookup
    curve = spark.read.parquet(paths["cox_baseline"]).orderBy("t").collect()
    assert all(a["survival"] >= b["survival"] for a, b in zip(curve, curve[1:])) and fit.diagnosis.status in ("PASS", "WARN", "FAILED")
