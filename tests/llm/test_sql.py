import pytest

from orderloom.llm import queries

from ..oracle import connect, rows_of, wanted


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, sf, name):
    assert rows_of(queries.queries()[name](spark, sf)) == wanted(connect(sf), queries.oracle_sql()[name])
