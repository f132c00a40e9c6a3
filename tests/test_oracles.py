"""Every query against its SQL on the same tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tallyfold_checks.compare import connect, difference


@pytest.fixture(scope="module")
def db(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, small, db, name):
    df = queries()[name](spark, small)
    if name in oracle_sql():
        assert difference(df, db, oracle_sql()[name]) is None
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:2] == ["customerid", "country"]
    assert df.count() > 0
