import pytest

from orderloom import catalogue

from .oracle import connect, rows_of, wanted


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_agrees_with_sql(spark, sf, con, name):
    got = rows_of(catalogue.queries()[name](spark, sf))
    assert got == wanted(con, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() >= 0
