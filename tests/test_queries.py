"""Every registered query of the reference's operators against its SQL."""

import pytest
from compare import connect, difference

from memspark.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, sf, con, name):
    assert difference(registry.QUERIES[name](spark, sf), con, registry.ORACLE_SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
