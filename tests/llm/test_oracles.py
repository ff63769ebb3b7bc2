"""The queries that SQL can express against DuckDB over the given tables."""

import os

import duckdb
import pytest

from promolens.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no given tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    wanted, got = duck.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, SF)
    columns = sorted(wanted.columns)
    assert columns == sorted(got.columns)
    expected = [tuple(r[wanted.columns.index(c)] for c in columns) for r in wanted.fetchall()]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(expected, key=str)
