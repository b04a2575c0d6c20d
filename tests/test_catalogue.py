"""Every registered query against its SQL; those without, for their shape."""

import pytest

import areasignal.plans as plans
from compare import DATA, difference


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert difference(plans.QUERIES[name](spark, DATA), con, plans.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_rows_without_sql(spark, name):
    df = plans.QUERIES[name](spark, DATA)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
