import pytest

import flightframe.plans as plans
from tests.compare import SF_DIR, assert_same, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert name in plans.ORACLES
    assert_same(plans.QUERIES[name](spark, SF_DIR), con, plans.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
