"""Every registered query against DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import entry_oracles
import entry_queries
from check_oracles import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(entry_queries.QUERIES) == set(entry_oracles.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_duckdb(spark, con, name):
    assert compare(spark, con, FOLDER, name) is None


def test_flagship_entry(spark):
    assert entry.entry(spark).count() > 0


def test_policy_removed_returns_every_row(spark):
    got = entry.queries()["policy_removed"](spark, FOLDER)
    customers = spark.read.parquet(f"{FOLDER}/customer.parquet").count()
    assert {(r["state"], r["view_exists"]): r["count"] for r in got.groupBy("state", "view_exists").count().collect()} == {
        ("before", True): customers,
        ("after", False): customers,
    }
    plain = got.where("email LIKE '%@%'").select("state").distinct().collect()
    assert [r["state"] for r in plain] == ["before"]
    assert "customer_id" in got.columns
