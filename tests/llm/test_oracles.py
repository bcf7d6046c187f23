import pytest
from compare import agree

from tessera.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, name):
    agree(registry.QUERIES[name](spark, sf), registry.ORACLES[name], sf)
