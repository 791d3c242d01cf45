"""Every registered query against DuckDB on the smallest tables."""

import os

import pytest
from compare import differences, duck

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    assert differences(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) is None


def test_entry(spark):
    assert entry(spark).count() > 0
