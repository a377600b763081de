"""Every registered query against its SQL; those without SQL run and give rows of a stable schema."""

import pytest

from corpusloom.plans import catalog
from tests.compare import check

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, name):
    check(spark, data, QUERIES[name], SQL.get(name))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)
