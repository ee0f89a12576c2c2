import pytest
from tessera.llm import registry

from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    compare(spark, connect(SF), SF, name, registry.queries()[name], registry.oracle_sql()[name])
