"""Every registered query against its SQL, on the whole tables."""

import pytest

from compare import difference, odd_types
from plumbline.plans import registry

registry.load_all()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, data, name):
    df = registry.QUERIES[name](spark, data)
    sql = registry.ORACLES.get(name)
    if sql is None:
        assert df.columns and df.count() > 0
        return
    assert not odd_types(duck, sql)
    assert difference(df, duck, sql, exact=True) is None


def test_contract():
    import importlib

    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) == set(registry.ORACLES)
