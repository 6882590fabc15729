import pytest

from harrow.plans import queries

from .oracle import assert_same, connect

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_same_as_duckdb(spark, con, name):
    assert_same(queries.queries()[name](spark, SF), queries.ORACLES[name], con)
