import pytest

from geoloom.plans import catalog
from tests.oracle import assert_same

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf, duck):
    assert_same(catalog.queries()[name](spark, sf), duck.sql(SQL[name]))


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and sum(r.n_cells for r in rows) > 0
