"""Every registered query against its SQL oracle on the smallest tables."""

import os

import pytest
from oracle import connect, difference

import __spark_entry__ as driver

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    problem = difference(QUERIES[name](spark, FOLDER), con, ORACLES[name])
    assert problem in (None, "no rows on either side"), problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0
