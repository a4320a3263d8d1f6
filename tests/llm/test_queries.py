"""The operators' registered queries against DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from tests.test_queries import SF, TABLES, rows
from tidegauge.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, sql = queries.queries()[name](spark, SF), c.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())
