import pytest

from lectern.plans import ORACLES, QUERIES
from tests import oracle


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        oracle.check(spark, QUERIES[name], ORACLES[name])
    else:
        assert QUERIES[name](spark, oracle.SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
