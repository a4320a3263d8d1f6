"""Windows, roll-ups and timers over streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.functions.aggregates import Aggregate
from tidegauge.operators.rollup import Rollup
from tidegauge.sources.events import second_of


def _instant(stream: DataFrame, ts: str) -> Column:
    """The event's whole second as a timestamp; a column without zone counts as UTC."""
    return F.timestamp_seconds(second_of(stream, ts))


def window_stream(stream: DataFrame, spec: Aggregate, value: Column, ts: str, size: int, slide: int, origin: int, delay: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, window_start, window_end, fields, value) of sliding windows (tumbling if slide equals size) that start at the origin or later, once the watermark passes their end.

    For append mode. The watermark runs `delay` seconds behind the newest event; later ones are dropped. A stream's empty windows aren't emitted: sliding() over the stored roll-up has them.
    """
    rows = stream.withColumn("_t", _instant(stream, ts)).withColumn("_in", value).withWatermark("_t", f"{delay} seconds")
    w = F.window("_t", f"{size} seconds", f"{slide} seconds", f"{origin % slide} seconds")
    out = rows.groupBy(w, *keys).agg(*spec.lifted(F.col("_in")))
    start, end = F.unix_seconds("window.start"), F.unix_seconds("window.end")
    return out.where(start >= origin).select(*keys, start.alias("window_start"), end.alias("window_end"), *spec.filled()).withColumn("value", spec.lowered())


def session_stream(stream: DataFrame, spec: Aggregate, value: Column, ts: str, timeout: int, delay: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Sessions of a stream, as sessions() makes them, once the watermark passes their end. Without keys a constant stands for one, since a stream's sessions need a key."""
    rows = stream.withColumn("_t", _instant(stream, ts)).withColumn("_in", value).withColumn("_all", F.lit(0)).withWatermark("_t", f"{delay} seconds")
    out = rows.groupBy(F.session_window("_t", f"{timeout} seconds"), *(keys or ["_all"])).agg(*spec.lifted(F.col("_in")))
    start, end = F.unix_seconds("session_window.start"), F.unix_seconds("session_window.end")
    return out.select(*keys, start.alias("window_start"), end.alias("window_end"), *spec.filled()).withColumn("value", spec.lowered())


def roll_up_stream(stream: DataFrame, spec: Aggregate, value: Column, ts: str, path: str, checkpoint: str, keys: Sequence[str] = (), on_batch: Callable[[SparkSession, int], None] | None = None) -> StreamingQuery:
    """Each micro-batch's partials per second, written under path by batch: a batch that runs again overwrites itself. Late rows make further partials of a second; readers combine them.

    on_batch(session, batch) runs after each batch: a timer's hook, which may ask load_roll_up().
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("slot", second_of(batch, ts)).withColumn("_in", value).where("slot is not null")
        rows.groupBy(*keys, "slot").agg(*spec.lifted(F.col("_in"))).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if on_batch:
            on_batch(batch.sparkSession, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_roll_up(spark: SparkSession, path: str, spec: Aggregate, origin: int, watermark: int, keys: Sequence[str] = ()) -> Rollup:
    """The roll-up of what roll_up_stream() has written, between origin and watermark."""
    rows = spark.read.parquet(path).where((F.col("slot") >= origin) & (F.col("slot") < watermark))
    return Rollup._from_seconds(rows.groupBy(*keys, "slot").agg(*spec.combined()), spec, origin, watermark, tuple(keys))


def on_time(events: DataFrame, ts: str, arrival: str, step: int, delay: int) -> DataFrame:
    """The rows of a recorded stream that aren't late: at arrival the watermark stands at the last multiple of `step` seconds of arrival time, less `delay`; a row at the watermark is on time."""
    at = second_of(events, arrival)
    return events.where(second_of(events, ts) >= at - F.pmod(at, F.lit(step)) - delay)
