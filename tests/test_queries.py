"""Every registered query over the smallest tables, against its SQL if it has one."""

import pytest
from oracle import same

from tidewater.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, sf, name):
    """Those without SQL are in test_brute.py."""
    same(registry.QUERIES[name](spark, sf), registry.SQL[name], sf)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_sql_is_rare():
    assert len(registry.SQL) > 0.9 * len(registry.QUERIES)
