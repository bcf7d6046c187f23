import pytest
from compare import agree

from tessera import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_sql(spark, sf, name):
    agree(plans.QUERIES[name](spark, sf), plans.ORACLES[name], sf)
