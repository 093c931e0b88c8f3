"""Every query with SQL gives the same rows as its SQL; every other one gives rows."""

import pytest
from conftest import rows_of

from tesserae import plans, registry  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.ORACLES:
        assert len(got.columns)
        return
    want = duck.sql(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_entry_points():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(registry.QUERIES) <= set(q)
    assert set(o) <= set(q)
