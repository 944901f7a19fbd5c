"""Every registered query of the library against its SQL on the smallest tables."""

import pytest
from compare import compare

from evalloom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    """Their values are held to plain Python in test_whole_tables, test_values and test_catalogue."""
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
