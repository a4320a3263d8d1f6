"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; the median counts. Roll-ups are built and stored once, timed as
`build`; `rollup_*` ask the stored levels, `scan_*` the events, for the same random ranges: 20 of each level, which `scan` aggregates
to levels first, and 1000 of each, which `scan` compares with every event.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = ("range_sum", "range_all", "landmark_all", "group_by_15m", "tumbling_30m_all", "sliding_1h_10m", "session_10m", "session_1h_by_user", "topn_users_desc", "keyed_range_time", "distinct_users_by_week", "bitmap_membership", "merge_two_halves", "ship_week_revenue", "orders_daily_minmax", "prefix_range_sum", "timer_repeat_6h")


def main() -> None:
    from pyspark.sql import SparkSession

    from tidegauge import queries as q
    from tidegauge.functions.aggregates import SUM

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run, repeat: int = 3) -> None:
        took = []
        for _ in range(repeat + 1):
            t = time.perf_counter()
            run()
            took.append(time.perf_counter() - t)
        times[name] = round(statistics.median(took[1:] or took), 4)

    def scan(spark, sf, q, ranges):
        """The ranges' sums from the events alone."""
        e = q.read_table(spark, sf, "events").select(q.second_of(q.read_table(spark, sf, "events"), "ts").alias("s"), q._cents().alias("v"))
        asked = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "i int, start long, end long")
        return e.join(q.F.broadcast(asked), (q.F.col("s") >= q.F.col("start")) & (q.F.col("s") < q.F.col("end"))).groupBy("i", "start", "end").agg(q.F.sum("v").alias("sum"))

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        timed(name, lambda name=name: noop(q.QUERIES[name](spark, sf)))
    with tempfile.TemporaryDirectory() as d:
        built = q._events(spark, sf, SUM)
        timed("build", lambda: built.stored(d), 0)
        stored = built.load(spark, d, SUM, q.ORIGIN, q.WATERMARK)
        for level in ("second", "minute", "hour", "day"):
            ranges = q.random_ranges(level)
            timed(f"rollup_20_ranges_{level}", lambda r=ranges: noop(q._many(stored, r)))
            timed(f"scan_20_ranges_{level}", lambda r=ranges: noop(q._many(built, r)))
            ranges = q.random_ranges(level, 1000, 11)
            timed(f"rollup_1000_ranges_{level}", lambda r=ranges: noop(q._many(stored, r)), 2)
            timed(f"scan_1000_ranges_{level}", lambda r=ranges: noop(scan(spark, sf, q, r)), 1)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
