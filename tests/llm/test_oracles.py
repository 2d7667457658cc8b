import pytest

from scriptorium.llm import queries

from ..conftest import same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, duck, sf, name):
    assert same(queries.QUERIES[name](spark, sf), duck, queries.SQL[name]) > 0
