"""Every registered query with SQL equals it; the others run and have rows."""

import compare
import pytest

from ebbflow.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, sf, name):
    columns, rows = compare.spark_rows(catalog.QUERIES[name](spark, sf))
    assert (columns, rows) == compare.sql_rows(sf, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_has_rows(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
