import pytest
from tessera import queries_runs as queries

from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, con, name):
    compare(spark, con, SF, name, queries.QUERIES[name], queries.ORACLES[name])
