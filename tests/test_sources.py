"""Events from every format and timestamp type."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidegauge.functions.aggregates import AVG, COUNT, DISTINCT, SUM, of_attributes
from tidegauge.operators.rollup import Rollup
from tidegauge.sources.events import between, read_events, second_of

ROWS = [(1, 1500), (2, 2999), (3, 3000)]
SCHEMA = "v long, ms long"


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats(spark, tmp_path, fmt):
    spark.createDataFrame(ROWS, SCHEMA).write.format(fmt).option("header", True).save(str(tmp_path / fmt))
    df = read_events(spark, str(tmp_path / fmt), fmt, SCHEMA)
    assert Rollup.build(df, SUM, F.col("v"), "ms", 2, 3).landmark().collect()[0].value == 2


def test_unknown_format_and_column(spark):
    with pytest.raises(ValueError):
        read_events(spark, "x", "xml")
    with pytest.raises(ValueError):
        second_of(spark.createDataFrame([("a",)], "ts string"), "ts")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_timestamps_before_the_epoch_and_in_another_zone(spark, kind):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York" if kind == "timestamp_ntz" else "UTC")
    try:
        df = spark.sql(f"SELECT explode(array({kind}'1969-12-31 23:59:58.5', {kind}'1970-01-01 00:00:00', {kind}'2024-03-10 02:30:00.9')) AS ts")
        want = [-2, 0, int(datetime(2024, 3, 10, 2, 30, tzinfo=UTC).timestamp())]
        assert [r.s for r in df.select(second_of(df, "ts").alias("s")).collect()] == want
        assert between(df, "ts", -2, 1).count() == 2 and between(df, "ts", 1, want[2] + 1).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id AS v", "timestamp_ntz'2024-01-01' AS ts", "'x' AS other").write.parquet(str(tmp_path / "e"))
    df = Rollup.build(spark.read.parquet(str(tmp_path / "e")), SUM, F.col("v"), "ts", 0, 2_000_000_000).combine_range(5, 1_800_000_000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "other" not in plan


def test_struct_of_aggregates_and_distinct(spark):
    df = spark.createDataFrame([(50, 100, 0), (30, 55, 1000), (29, 65, 2000)], "w long, t long, ms long")
    both = of_attributes(wind=("w", AVG), temperature=("t", AVG), n=("t", COUNT))
    x = Rollup.build(df, both, F.struct("w", "t"), "ms", 0, 3).landmark().collect()[0].value
    assert (round(x.wind, 2), round(x.temperature, 2), x.n) == (36.33, 73.33, 3)
    d = Rollup.build(df, DISTINCT, F.col("w") % 2, "ms", 0, 3)
    assert d.landmark().collect()[0].value == [0, 1] and d.level("year").collect()[0]["set"] == [0, 1]
