import pytest

from tallyforge.plans import registry
from tests.oracle import connect, same

WITH_SQL = sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_its_oracle(spark, small, name):
    same(registry.queries()[name](spark, small), connect(small), registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(WITH_SQL)))
def test_query_without_oracle_runs(spark, small, name):
    assert registry.queries()[name](spark, small).columns


def test_entry_has_rows(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
