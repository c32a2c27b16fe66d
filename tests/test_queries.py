"""Every query of the pixel and table operators against its SQL."""

import compare
import pytest

from gridloom.queries import ORACLE_SQL, QUERIES, SIEVE_SQL, flagship


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE_SQL:
        assert not compare.differences(df, con, ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_flagship(spark, sf):
    assert {c for c in flagship(spark, sf).columns} == {"value", "pixels", "percent", "area"}


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_sieve(spark, sf, con):
    assert not compare.differences(QUERIES["sieve"](spark, sf), con, SIEVE_SQL)
