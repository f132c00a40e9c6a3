import pytest

from tallyfold.llm.queries import ORACLES, QUERIES
from tallyfold_checks import compare


@pytest.fixture(scope="module")
def db(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, db, name):
    assert compare.difference(QUERIES[name](spark, small), db, ORACLES[name]) is None
