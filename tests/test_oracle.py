import pytest
from compare import connect, same

from millrace.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, sf, name):
    same(spark, con, registry.queries()[name], SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs_without_sql(spark, sf, name):
    assert registry.queries()[name](spark, sf).toPandas().shape[1] > 0
