"""Every registered query against its SQL, whole tables, bit for bit."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    from tidemark.plans.queries import QUERIES as own

    assert set(own) <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_sql(spark, con, sf_dir, key):
    result = compare(spark, con, sf_dir, QUERIES[key], SQL[key])
    spark.catalog.clearCache()
    assert result[2] == "ok", result[2]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["ticker", "date", "close"] and df.count() > 0
