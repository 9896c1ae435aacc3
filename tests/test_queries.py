"""Every query with an SQL form against DuckDB, and the label constants."""

import os

import pytest

import __spark_entry__ as entry
import compare

SF_DIR = os.environ.get("EMBERFIELD_TEST_SF", "/root/testdata/sf0.001")
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    got = compare.from_spark(entry.queries()[name](spark, SF_DIR))
    assert compare.difference(got, compare.from_duckdb(con, ORACLE[name])) is None
    assert got[1]


def test_entry_counts(spark):
    counts = {r["category"]: r["n"] for r in entry.entry(spark).collect()}
    assert counts == {
        "Agricultural Burning": 78, "Anomaly/Unclassified": 300, "Industrial (Normal)": 469,
        "Wildfire Risk": 144,
    }


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(entry.queries())
