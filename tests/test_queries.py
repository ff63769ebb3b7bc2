"""Every registered query against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from promolens.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    def value(v):
        if pd.isna(v):
            return ""
        return str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(value(v.item() if hasattr(v, "item") else v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got, expected = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE[name]).df()
    assert set(got.columns) == set(expected.columns)
    assert rows(got) == rows(expected)
