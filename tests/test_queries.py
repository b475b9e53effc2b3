import pytest

from sparkwright import catalog
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, small, name):
    equal, why = same(catalog.QUERIES[name](spark, small), catalog.ORACLE_SQL[name], small)
    assert equal, why


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, tiny, name):
    """Queries without SQL give rows; their values are tested in the other modules."""
    assert catalog.QUERIES[name](spark, tiny).collect()
