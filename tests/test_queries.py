"""Every registered query against DuckDB, at the smallest scale."""

import decimal
import importlib
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
OWN = importlib.import_module("tidegauge.queries")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda x: float(x) if isinstance(x, decimal.Decimal) else x
    return sorted([tuple(plain(r[i]) for i in order) for r in values], key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(OWN.ORACLES))
def test_query(spark, duck, name):
    df, sql = OWN.QUERIES[name](spark, SF), duck.sql(OWN.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())


def test_bloom_misses_nothing(spark):
    got = {tuple(r) for r in OWN.QUERIES["bloom_membership"](spark, SF).collect()}
    assert {tuple(r) for r in OWN.QUERIES["bitmap_membership"](spark, SF).collect()} <= got


def test_bloom_is_asked_for_every_user(spark, duck):
    got = {tuple(r) for r in OWN.QUERIES["bloom_membership"](spark, SF).collect()}
    want = set(duck.sql("SELECT DISTINCT s - s % 3600, user_id FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)").fetchall())
    assert want <= got


def test_bloom_misses_adds_pairs_and_hits(spark, tmp_path):
    """Hours and users that are null count as in the SQL, and hits, whose number Spark underestimates, are never broadcast."""
    rows = [(i, f"2024-01-{1 + i % 9:02} 0{i % 5}:00:00", i % 7) for i in range(200)] + [(300, None, 3), (301, "2024-01-01 00:00:00", None), (302, None, None)]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long").selectExpr("event_id", "CAST(ts AS timestamp_ntz) AS ts", "user_id", "0.5D AS value")
    e.write.parquet(f"{tmp_path}/events.parquet")
    df = OWN.QUERIES["bloom_misses"](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert [tuple(r) for r in df.select("n_pairs", "n_missed").collect()] == c.sql(OWN.ORACLES["bloom_misses"]).fetchall()
    df = OWN.QUERIES["bloom_misses"](spark, SF)
    df.collect()
    assert not re.findall(r"Join \[slot", df._jdf.queryExecution().executedPlan().toString())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(OWN.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
