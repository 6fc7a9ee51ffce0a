"""Every registered panel query: against its SQL in DuckDB where there is one, else that it runs."""

import math

import duckdb
import pytest

from gridloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Many fits, run below; k_selection has a test of its own in test_operators.
FITS = {"model_family_cv", "leakage_experiments", "logistic_cv", "leave_one_out", "permutation_importance"}
SLOW = FITS | {"k_selection"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return f"{value:.5g}" if abs(value) > 1e-9 else "0"
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.sql(ORACLES[name])
    assert table(df.columns, df.collect()) == table(result.columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(FITS))
def test_fits_run(spark, name):
    """With all folds, trees, rounds and permutations."""
    rows = QUERIES[name](spark, SF).collect()
    models = {"model_family_cv": {"svm_linear", "svm_rbf", "random_forest", "knn", "mlp", "gradient_boosting", "xgboost"}, "logistic_cv": {"dummy_most_frequent", "dummy_stratified", "logistic_regression"}, "leave_one_out": {"logistic_regression", "random_forest", "svm_linear"}}
    if name in models:
        assert {r.model for r in rows} == models[name]
    assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
