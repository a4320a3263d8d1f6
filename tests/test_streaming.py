"""Streams against their batch twins."""

from pyspark.sql import functions as F

from tidegauge.functions.aggregates import SUM
from tidegauge.operators import windows
from tidegauge.operators.rollup import Rollup
from tidegauge.sources.events import read_events
from tidegauge.streaming import windows as st

SCHEMA = "v long, ms long"


def files(spark, path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


PARTS = [[(100, 5000), (200, 15_000)], [(300, 25_000), (400, 35_000)], [(500, 45_000), (0, 200_000)]]


def test_tumbling(spark, tmp_path):
    got = run(st.window_stream(files(spark, str(tmp_path / "in"), PARTS), SUM, F.col("v"), "ms", 30, 30, 0, 100), "tumbling", tmp_path)
    assert sorted((r.window_start, r.value) for r in got.collect()) == [(0, 600), (30, 900)]


def test_sessions(spark, tmp_path):
    got = run(st.session_stream(files(spark, str(tmp_path / "in"), PARTS), SUM, F.col("v"), "ms", 10, 100), "sessions", tmp_path)
    batch = windows.sessions(spark.read.parquet(str(tmp_path / "in")), SUM, F.col("v"), "ms", 10, 0, 100)
    key = lambda r: (r.window_start, r.window_end, r.value)
    assert sorted(map(key, got.collect())) == sorted(map(key, batch.collect()))


def test_roll_up_and_timer_hook(spark, tmp_path):
    seen = []
    q = st.roll_up_stream(files(spark, str(tmp_path / "in"), PARTS), SUM, F.col("v"), "ms", str(tmp_path / "out"), str(tmp_path / "cp"), on_batch=lambda s, n: seen.append(n))
    q.awaitTermination(120)
    assert seen == [0, 1, 2]
    got = st.load_roll_up(spark, str(tmp_path / "out"), SUM, 0, 100)
    want = Rollup.build(read_events(spark, str(tmp_path / "in")), SUM, F.col("v"), "ms", 0, 100)
    assert {tuple(r) for r in got.level("second").collect()} == {tuple(r) for r in want.level("second").collect()}
    assert got.landmark().collect()[0].value == 1500


def test_late_rows(spark):
    e = spark.createDataFrame([(1, 10_000, 10_000), (2, 9_000, 20_000), (3, 20_000, 20_000), (4, 19_999, 20_000)], "v long, ms long, at long")
    assert sorted(r.v for r in st.on_time(e, "ms", "at", 10, 0).collect()) == [1, 3]
