import pytest

from tessera.llm import registry
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)
