import re

import duckdb
import pytest

import __spark_entry__
from zonespark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {re.match(r"op(\d+)_", n)[1] for n in names if re.match(r"op\d+_", n)} == {str(n) for n in range(1, 14)} and "pipeline" in names
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_are_those_of_the_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    relation = connection.sql(ORACLES[name])
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(relation.columns)
    rows = [tuple(r[c] for c in relation.columns) for r in found.collect()]
    assert sorted(rows, key=repr) == sorted(relation.fetchall(), key=repr)
