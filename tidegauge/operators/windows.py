"""Event-time windows over a bounded table: tumbling, sliding and session, with a low watermark given by the caller."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.aggregates import Aggregate
from tidegauge.sources.events import between, second_of


def sliding(events: DataFrame, spec: Aggregate, value: Column, ts: str, size: int, slide: int, origin: int, watermark: int, keys: Sequence[str] = (), since: int | None = None) -> DataFrame:
    """(*keys, window_start, window_end, fields, value) of every window of `size` seconds, one each `slide` from origin on, that ends by the watermark; with `since`, only those that an advance from there to the watermark fires.

    No window starts before the origin, and none is missing: an empty one has the identity (with keys: for each key of the data). Events are first combined into
    slices of gcd(size, slide) seconds, and a slice is dealt to the size / slide windows that hold it, so rows don't multiply.
    """
    if size < slide or slide <= 0:
        raise ValueError("a window is at least as long as its slide, which is positive")
    g = gcd(size, slide)
    fired = 0 if since is None else max(0, (since - origin - size) // slide + 1)  # windows that were complete before
    rows = between(events, ts, origin + fired * slide, max(watermark, origin + fired * slide)).select(*keys, second_of(events, ts).alias("_s"), value.alias("_in"))
    slices = rows.groupBy(*keys, F.floor((F.col("_s") - origin) / g).alias("_i")).agg(*spec.lifted(F.col("_in")))
    last = (watermark - origin - size) // slide  # of the windows, counted from 0
    per, each = size // g, slide // g
    lo = F.greatest(F.lit(fired), F.ceil((F.col("_i") - (per - 1)) / each))
    hi = F.least(F.lit(last), F.floor(F.col("_i") / each))
    dealt = slices.where(lo <= hi).withColumn("_w", F.explode(F.sequence(lo, hi))).groupBy(*keys, "_w").agg(*spec.combined())
    spine = events.sparkSession.range(fired, max(fired, last + 1)).select(F.col("id").alias("_w"))
    if keys:
        # every window for every key: a key's windows are listed in its own row
        spine = slices.select(*keys).distinct().where(F.lit(last >= fired)).withColumn("_w", F.explode(F.sequence(F.lit(fired).cast("long"), F.lit(max(fired, last)).cast("long"))))
    start = F.col("_w") * slide + origin
    out = spine.join(dealt, [*keys, "_w"], "left").select(*keys, start.alias("window_start"), (start + size).alias("window_end"), *spec.filled())
    return out.withColumn("value", spec.lowered())


def tumbling(events: DataFrame, spec: Aggregate, value: Column, ts: str, size: int, origin: int, watermark: int, keys: Sequence[str] = (), since: int | None = None) -> DataFrame:
    """Sliding windows whose slide is their size."""
    return sliding(events, spec, value, ts, size, size, origin, watermark, keys, since)


def sessions(events: DataFrame, spec: Aggregate, value: Column, ts: str, timeout: int, origin: int, watermark: int, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, window_start, window_end, fields, value) of every session that is closed by the watermark.

    Events in seconds up to `timeout` apart are one session. It starts with its first event's second, ends `timeout` after its last, and is closed once the
    watermark has passed its end by a second. Events are combined by second, then by runs inside a day. Only a day's first and last run can go on in another day; these two alone, not the events, meet those
    of other days.
    """
    rows = between(events, ts, origin, max(origin, watermark)).select(*keys, second_of(events, ts).alias("_s"), value.alias("_in"))
    rows = rows.groupBy(*keys, "_s").agg(*spec.lifted(F.col("_in"))).withColumn("_e", F.col("_s"))

    def runs(df: DataFrame, part: list) -> DataFrame:
        w = Window.partitionBy(*part).orderBy("_s")
        new = F.when(F.col("_s") - F.lag("_e").over(w) <= timeout, 0).otherwise(1)
        numbered = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*part, "_run").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), *spec.combined())

    days = runs(rows.withColumn("_day", F.floor(F.col("_s") / 86_400)), [*keys, "_day"])
    day = Window.partitionBy(*keys, "_day")
    days = days.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(day))).drop("_run", "_day")
    kept = [*keys, "_s", "_e", *spec.fields]
    whole = days.where(~F.col("_edge")).select(*kept).unionByName(runs(days.where("_edge").drop("_edge"), list(keys)).select(*kept))
    out = whole.select(*keys, F.col("_s").alias("window_start"), (F.col("_e") + timeout).alias("window_end"), *spec.filled()).where(F.col("window_end") + 1 <= watermark)
    return out.withColumn("value", spec.lowered())
