"""Every plan with SQL gives the same rows as DuckDB; the others run."""

import pytest
from compare import database, difference

from sluice.plans import PLANS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", [n for n, p in PLANS.items() if p.sql])
def test_same_as_sql(spark, con, name):
    assert difference(spark, PLANS[name], con, FOLDER) is None


@pytest.mark.parametrize("name", [n for n, p in PLANS.items() if not p.sql])
def test_runs(spark, name):
    assert PLANS[name](spark, FOLDER).count() > 0


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
