"""Every query against its SQL; those without SQL must run and keep their columns."""

import pytest

from lodestack.plans import catalog
from tests.compare import difference


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, name):
    f, sql = catalog.queries()[name], catalog.oracle_sql().get(name)
    if sql:
        assert difference(spark, f, sql, sf_dir) == ""
    else:
        df = f(spark, sf_dir)
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
