"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from pagequarry import plans
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(plans.SQL) == set(plans.QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    rows, difference = compare(plans.QUERIES[name](spark, FOLDER), plans.SQL[name], con)
    assert difference is None
    assert rows > 0
