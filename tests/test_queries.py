import pytest

from linkloom import plans
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, name):
    if name in plans.ORACLES:
        same(spark, sf, plans.QUERIES[name], plans.ORACLES[name])
    else:
        assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
