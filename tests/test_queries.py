"""Every registered query against its oracle on the same tables."""

import pytest

from lorekeep.plans import registry
from tests.parity import connect, differences

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_oracle(spark, duck, name):
    assert differences(registry.QUERIES[name](spark, SF), duck, registry.ORACLE_SQL[name]) == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 30
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    plan = registry.QUERIES["regional_revenue"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(r_name), EqualTo(r_name,ASIA)" in plan
    lineitem = next(line for line in plan.splitlines() if "ReadSchema" in line and "l_orderkey" in line)
    assert "l_shipdate" not in lineitem and "l_comment" not in lineitem
