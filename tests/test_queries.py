"""Every registered query against independent SQL, over whole tables."""

from __future__ import annotations

import importlib

import pytest
from compare import compare, open_tables
from conftest import SF_DIR

from vintry.catalog import oracle, queries

contract = importlib.import_module("__spark_entry__")
QUERIES, ORACLE = queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return open_tables(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, tables, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython"):
        assert forbidden not in plan
    result = compare(df, tables, ORACLE[name])
    assert result["columns"], result
    assert result["values"], result
    assert not result["types"], result


def test_flagship_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "net_margin" in df.columns
