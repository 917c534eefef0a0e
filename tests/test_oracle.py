"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import pytest

import __spark_entry__ as E
from strata.plans.catalog import REGISTRY
from tools.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(REGISTRY)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle_or_is_declared_rows_only():
    assert set(REGISTRY) <= set(E.queries())
    assert set(REGISTRY) <= set(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF)
    assert r.get("ok") is not False, r
