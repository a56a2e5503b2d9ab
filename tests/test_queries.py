"""Every query of the engine's own operators against its SQL; the others give rows."""

import pytest
from oracle import both

from lodestone import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, spark, sf):
    df = QUERIES[name](spark, sf)
    mine, theirs = both(df, SQL[name], sf)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
