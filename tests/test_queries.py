"""Every query of the library gives the rows of its SQL, on the smallest tables."""

from __future__ import annotations

import compare
import pytest

from sparkloom.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert compare.differences(catalog.queries()[name](spark, SF), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.count() > 0 and df.columns
