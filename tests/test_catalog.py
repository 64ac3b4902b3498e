"""Every registered query beside its SQL, on the smallest data."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from zonespark.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 4000


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    good, note = compare(spark, con, SF, QUERIES[name], ORACLES.get(name))
    assert good, note
