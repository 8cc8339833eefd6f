"""Every registered query against its SQL twin on whole tables."""

import compare
import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.01"  # the size of the driver's comparison

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    message, _, rows = compare.compare(spark, con, name, QUERIES[name], SQL[name], FOLDER)
    assert message is None, message
    assert rows > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_and_repeats(spark, name):
    first = compare.rows(QUERIES[name](spark, FOLDER).toPandas())
    assert first
    again = compare.rows(QUERIES[name](spark, FOLDER).toPandas())
    assert first == again


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)
