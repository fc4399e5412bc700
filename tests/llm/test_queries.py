import pytest
from compare import connect, same

from millrace.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, sf, name):
    same(spark, connect(sf), queries.QUERIES[name], queries.ORACLE[name], sf)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0
