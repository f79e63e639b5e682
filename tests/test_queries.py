"""Every query with SQL gives the same rows; queries without one run and keep their sizes."""

import os

import pytest
from oracle import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from gaugeline.plans import QUERIES

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) & set(QUERIES)))
def test_matches_sql(spark, con, name):
    report = differences(queries()[name](spark, SF_DIR), con, oracle_sql()[name])
    assert not report, report


def test_no_query_is_empty():
    """At the size of the correctness run every query has rows to compare."""
    con = connect("/root/testdata/sf0.01")
    empty = [n for n, sql in oracle_sql().items() if n in QUERIES and not con.execute(f"select count(*) from ({sql})").fetchone()[0]]
    assert not empty


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_every_query_of_the_series_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql())
