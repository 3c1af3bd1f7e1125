"""Differential test: every registered query with an SQL restatement equals
DuckDB on sf0.001 (the driver does the same at sf0.01)."""

import pytest
from oracle_check import compare

from cohort_spark.plans.oracle import SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, name):
    rep = compare(spark, SMALL, [name], verbose=False)[name]
    assert "error" not in rep, rep.get("error")
    assert rep["cols_match"] and rep["rows_match"] and rep["values_match"], rep


ROWS_ONLY = {"m4_train_evaluate", "m6_model_scores", "m8_train_job"}


def test_every_query_has_sql_or_is_rows_only():
    from cohort_spark.plans.catalog import QUERIES
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert set(SQL) <= set(QUERIES)
