"""Every registered query against its SQL."""

import pytest
from oracle import connect, differences

from pagemill.plans.catalogue import ORACLES, QUERIES

ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def tables(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, tables, name):
    df = QUERIES[name](spark, sf)
    if name in ROWS_ONLY:
        assert df.count() > 0
    else:
        assert differences(df, tables, ORACLES[name]) == []


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
