"""Every registered query that has SQL gives the same rows as DuckDB on the same tables."""

import os

import pytest

import __spark_entry__ as entry
import check

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    ok, note = check.compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert ok, note


def test_every_query_has_a_family_and_names_are_plain():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.limit(1).count() == 1
    assert "label" in df.columns
