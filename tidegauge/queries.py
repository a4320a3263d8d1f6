"""The registered queries over the driver's tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.aggregates import ALL, AVG, AVG_INT, COUNT, MAX, MIN, MINMAX, SUM, Aggregate, of_attributes
from tidegauge.operators import sets, windows
from tidegauge.operators.rollup import Retention, Rollup, slot_of
from tidegauge.plans.ranges import LEVELS
from tidegauge.sources.events import between, read_table, scratch, second_of
from tidegauge.streaming import windows as streams
from tidegauge.streaming.windows import on_time

#: 2024-01-01 and 2024-01-31, between which all events lie; the range of the flagship query, 2024-01-05 15:50:50 to 2024-01-20 12:30:45.
ORIGIN, WATERMARK, START, END = 1_704_067_200, 1_706_659_200, 1_704_469_850, 1_705_753_845
#: 1995-01-01 and 2002-01-01, around the shipments and orders.
OLD, NEW = 788_918_400, 1_009_843_200
DAY, HOUR = 86_400, 3600

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_E = "(SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(round(value * 100) AS BIGINT) AS v FROM events)"
_L = "(SELECT *, CAST(epoch(l_shipdate) AS BIGINT) AS s, CAST(round(l_extendedprice * 100) AS BIGINT) AS v, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"
_O = "(SELECT *, CAST(epoch(o_orderdate) AS BIGINT) AS s, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders)"


def _cents(column: str = "value"):
    return F.round(F.col(column) * 100).cast("long")


def _events(spark: SparkSession, sf: str, spec: Aggregate = SUM, keys: tuple[str, ...] = (), start: int = ORIGIN, end: int = WATERMARK) -> Rollup:
    return Rollup.build(read_table(spark, sf, "events"), spec, _cents(), "ts", start, end, keys)


_STORED: dict[tuple, Rollup] = {}


def _stored(spark: SparkSession, sf: str, spec: Aggregate = SUM, keys: tuple[str, ...] = ()) -> Rollup:
    """The roll-up of all events with its levels written to the shared folder, once in an application."""
    key = spark.sparkContext.applicationId, sf, spec.name, keys
    if key not in _STORED:
        _STORED[key] = _events(spark, sf, spec, keys).stored(scratch(spark, f"rollup-{spec.name}"))
    return _STORED[key]


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


# name of the aggregate: (aggregate, output columns from `value` or fields, the same in SQL over v)
_LOWER = {
    "sum": (SUM, ["value AS value"], "CAST(coalesce(sum(v), 0) AS BIGINT) AS value"),
    "count": (COUNT, ["value AS value"], "count(v) AS value"),
    "min": (MIN, ["value AS value"], "min(v) AS value"),
    "max": (MAX, ["value AS value"], "max(v) AS value"),
    "minmax": (MINMAX, ["value.min AS min", "value.max AS max"], "min(v) AS min, max(v) AS max"),
    "avg": (AVG, ["sum", "count", "round(value, 6) AS value"], "CAST(coalesce(sum(v), 0) AS BIGINT) AS sum, count(v) AS count, round(sum(v)::DOUBLE / nullif(count(v), 0), 6) AS value"),
    "avg_int": (AVG_INT, ["value AS value"], "CAST(sum(v) // nullif(count(v), 0) AS BIGINT) AS value"),
    "all": (ALL, ["value.min AS min", "value.max AS max", "value.count AS count", "value.sum AS sum", "round(value.avg, 6) AS avg"], "min(v) AS min, max(v) AS max, count(v) AS count, CAST(coalesce(sum(v), 0) AS BIGINT) AS sum, round(sum(v)::DOUBLE / nullif(count(v), 0), 6) AS avg"),
}

for _name, (_spec, _out, _sql) in _LOWER.items():
    _add(f"range_{_name}", lambda spark, sf, spec=_spec, out=_out: _events(spark, sf, spec).combine_range(START, END).selectExpr(*out), f"SELECT {_sql} FROM {_E} WHERE s >= {START} AND s < {END}")
    _add(f"landmark_{_name}", lambda spark, sf, spec=_spec, out=_out: _events(spark, sf, spec).landmark().selectExpr(*out), f"SELECT {_sql} FROM {_E}")
    _add(f"tumbling_30m_{_name}", lambda spark, sf, spec=_spec, out=_out: windows.tumbling(read_table(spark, sf, "events"), spec, _cents(), "ts", 1800, ORIGIN, WATERMARK).selectExpr("window_start", "window_end", *out), f"SELECT w AS window_start, w + 1800 AS window_end, {_sql} FROM range({ORIGIN}, {WATERMARK}, 1800) t(w) LEFT JOIN {_E} e ON s - s % 1800 = w GROUP BY w")


def _slot_sql(level: str, origin: int) -> str:
    return f"s - (s - {origin}) % {LEVELS[level]}" if level in ("week", "year") else f"s - s % {LEVELS[level]}"


def random_ranges(level: str, n: int = 20, seed: int = 7) -> list[tuple[int, int]]:
    """Ranges with both bounds on a level's slots, between origin and watermark."""
    r, size = random.Random(f"{level}{seed}"), LEVELS[level]
    return [tuple(sorted((r.randrange(ORIGIN, WATERMARK, size), r.randrange(ORIGIN + size, WATERMARK + 1, size)))) for _ in range(n)]


def _many(rollup: Rollup, ranges: list[tuple[int, int]]) -> DataFrame:
    """Sums of many ranges at once. Each range's plan names the slots it combines, which meet a level's rows by slot; of a level only what lies between the first and the last of these is read."""
    spark, out, kept = rollup.levels["second"].sparkSession, None, rollup.spec.fields
    pieces = [(i, p.level, p.start, p.end) for i, (a, b) in enumerate(ranges) for p in rollup.plan(a, b).pieces]
    for level in dict.fromkeys(x[1] for x in pieces):
        mine = [(i, s, e) for i, lv, s, e in pieces if lv == level]
        slots = F.explode(F.sequence(F.col("s"), F.col("e") - LEVELS[level], F.lit(LEVELS[level]))).alias("slot")
        asked = spark.createDataFrame(mine, "i int, s long, e long").select("i", slots)
        rows = rollup._rows(level, min(s for _, s, _ in mine), max(e for _, _, e in mine)).join(asked, "slot").groupBy("i").agg(*rollup.spec.combined())
        out = rows if out is None else out.unionByName(rows)
    asked = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "i int, start long, end long")
    got = out.groupBy("i").agg(*rollup.spec.combined())
    return asked.join(got, "i", "left").select("start", "end", *rollup.spec.filled())


def _many_sql(ranges: list[tuple[int, int]]) -> str:
    values = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(ranges))
    return f"SELECT a AS start, b AS end, CAST(coalesce(sum(v), 0) AS BIGINT) AS value FROM (VALUES {values}) r(i, a, b) LEFT JOIN {_E} ON s >= a AND s < b GROUP BY i, a, b"


for _level in ("second", "minute", "hour", "day"):
    _ranges = random_ranges(_level)
    _add(f"range_sum_{_level}s", lambda spark, sf, ranges=_ranges: _many(_events(spark, sf), ranges).withColumnRenamed("sum", "value"), _many_sql(_ranges))
    _ranges = random_ranges(_level, 1000, 11)
    _add(f"stored_1000_ranges_{_level}", lambda spark, sf, ranges=_ranges: _many(_stored(spark, sf), ranges).withColumnRenamed("sum", "value"), _many_sql(_ranges))

_add("range_raw_scan", lambda spark, sf: between(read_table(spark, sf, "events"), "ts", START, END).agg(F.sum(_cents()).alias("value")), f"SELECT CAST(sum(v) AS BIGINT) AS value FROM {_E} WHERE s >= {START} AND s < {END}")
_PIECES = (
    ("second", START, 1_704_469_860, 10),
    ("minute", 1_704_469_860, 1_704_470_400, 9),
    ("hour", 1_704_470_400, 1_704_499_200, 8),
    ("day", 1_704_499_200, 1_705_708_800, 14),
    ("hour", 1_705_708_800, 1_705_752_000, 12),
    ("minute", 1_705_752_000, 1_705_753_800, 30),
    ("second", 1_705_753_800, END, 45),
)
_add(
    "range_explain",
    lambda spark, sf: _stored(spark, sf).explain(START, END),
    "SELECT * FROM (VALUES " + ", ".join(f"({i}, 'combined', '{lv}', {a}::BIGINT, {b}::BIGINT, {n}::BIGINT, 135::BIGINT)" for i, (lv, a, b, n) in enumerate(_PIECES)) + ") t(seq, kind, level, start, \"end\", slots, cost)",
)
_IN = f"s >= {START} AND s < {END}"
_add("range_analyze", lambda spark, sf: _events(spark, sf).analyze(START, END).select("value", "kind", "cost"), f"SELECT CAST(sum(v) AS BIGINT) AS value, 'scan' AS kind, {END - START}::BIGINT AS cost FROM {_E} WHERE {_IN}")
_add("stored_analyze", lambda spark, sf: _stored(spark, sf).analyze(START, END).select("value", "kind", "cost"), f"SELECT CAST(sum(v) AS BIGINT) AS value, 'combined' AS kind, 135::BIGINT AS cost FROM {_E} WHERE {_IN}")
_add(
    "stored_interval_stats",
    lambda spark, sf: _stored(spark, sf).interval_stats(DAY).select("value", "kind", "cost"),
    f"SELECT CAST(sum(v) AS BIGINT) AS value, 'single' AS kind, 1::BIGINT AS cost FROM {_E} WHERE s >= {WATERMARK - DAY} AND s < {WATERMARK}",
)
for _name in ("sum", "all", "avg"):
    _spec, _out, _sql = _LOWER[_name]
    _add(f"stored_range_{_name}", lambda spark, sf, spec=_spec, out=_out: _stored(spark, sf, spec).combine_range(START, END).selectExpr(*out), f"SELECT {_sql} FROM {_E} WHERE {_IN}")
    _add(f"stored_landmark_{_name}", lambda spark, sf, spec=_spec, out=_out: _stored(spark, sf, spec).landmark().selectExpr(*out), f"SELECT {_sql} FROM {_E}")
    _add(f"stored_interval_7d_{_name}", lambda spark, sf, spec=_spec, out=_out: _stored(spark, sf, spec).interval(7 * DAY).selectExpr(*out), f"SELECT {_sql} FROM {_E} WHERE s >= {WATERMARK - 7 * DAY} AND s < {WATERMARK}")
_add("stored_snapshot", lambda spark, sf: _stored(spark, sf, ALL).level("hour"), f"SELECT s - s % 3600 AS slot, min(v) AS min, max(v) AS max, count(v) AS count, CAST(sum(v) AS BIGINT) AS sum FROM {_E} GROUP BY 1")
_add(
    "stored_topk_time",
    lambda spark, sf: _stored(spark, sf, SUM, ("user_id",)).top_k(7, START, END).select("user_id", "value"),
    f"SELECT user_id, CAST(sum(v) AS BIGINT) AS value FROM {_E} WHERE {_IN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7",
)
_add(
    "stored_keyed_range",
    lambda spark, sf: _stored(spark, sf, SUM, ("user_id",)).where_key(F.col("user_id").between(3, 40)).combine_range(START, END, keyed=True).select("user_id", "value"),
    f"SELECT user_id, CAST(sum(v) AS BIGINT) AS value FROM {_E} WHERE user_id BETWEEN 3 AND 40 AND {_IN} GROUP BY 1",
)
_add(
    "stored_group_by_12h",
    lambda spark, sf: _stored(spark, sf).group_by(ORIGIN, WATERMARK, 12 * HOUR).select("slot", "value"),
    f"SELECT w AS slot, CAST(coalesce(sum(v), 0) AS BIGINT) AS value FROM range({ORIGIN}, {WATERMARK}, {12 * HOUR}) t(w) LEFT JOIN {_E} ON s - s % {12 * HOUR} = w GROUP BY w",
)
_add("level_stats", lambda spark, sf: _events(spark, sf).stats(), " UNION ALL ".join(f"SELECT '{lv}' AS level, count(DISTINCT slot) AS retained, min(slot) AS first, max(slot) AS newest, {'false' if lv in ('week', 'year') else 'true'} AS \"full\" FROM (SELECT {_slot_sql(lv, ORIGIN)} AS slot FROM {_E})" for lv in LEVELS))
for _label, _n in (("15s", 15), ("1m", 60), ("1h", HOUR), ("1d", DAY), ("7d", 7 * DAY)):
    _add(f"interval_{_label}", lambda spark, sf, n=_n: _events(spark, sf, COUNT).interval(n).select("value"), f"SELECT count(*) AS value FROM {_E} WHERE s >= {WATERMARK - _n} AND s < {WATERMARK}")
for _level, _a, _b in (("hour", START - START % HOUR, START - START % HOUR + 50 * HOUR), ("minute", START - START % 60, START - START % 60 + 200 * 60), ("second", START, START + 5000)):
    _add(f"range_slots_{_level}", lambda spark, sf, level=_level, a=_a, b=_b: _events(spark, sf).range(a, b, level).select("slot", "value"), f"SELECT w AS slot, CAST(coalesce(sum(v), 0) AS BIGINT) AS value FROM range({_a}, {_b}, {LEVELS[_level]}) t(w) LEFT JOIN {_E} ON s - s % {LEVELS[_level]} = w GROUP BY w")
for _label, _a, _b, _step, _clip in (("15m", START - START % 900, END, 900, False), ("12h", ORIGIN, WATERMARK, 12 * HOUR, False), ("2d_overshoot", ORIGIN + DAY, ORIGIN + 4 * DAY, 2 * DAY, False), ("2d_clipped", ORIGIN + DAY, ORIGIN + 4 * DAY, 2 * DAY, True), ("7s", START, START + 3600, 7, False)):
    _to = _b if _clip else _a + -(-(_b - _a) // _step) * _step
    _add(f"group_by_{_label}", lambda spark, sf, a=_a, b=_b, step=_step, clip=_clip: _events(spark, sf).group_by(a, b, step, clip).select("slot", "value"), f"SELECT w AS slot, CAST(coalesce(sum(v), 0) AS BIGINT) AS value FROM range({_a}, {_b}, {_step}) t(w) LEFT JOIN {_E} e ON s >= w AND s < w + {_step} AND s < {_to} GROUP BY w")


def _levels(rollup: Rollup) -> DataFrame:
    out = None
    for level in LEVELS:
        rows = rollup.level(level).agg(F.count(F.lit(1)).alias("slots"), F.sum("sum").alias("value")).select(F.lit(level).alias("level"), "slots", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


_add("landmark_by_level", lambda spark, sf: _levels(_events(spark, sf)), " UNION ALL ".join(f"SELECT '{lv}' AS level, count(DISTINCT {_slot_sql(lv, ORIGIN)}) AS slots, CAST(sum(v) AS BIGINT) AS value FROM {_E}" for lv in LEVELS))
for _level in LEVELS:
    _add(f"rollup_{_level}", lambda spark, sf, level=_level: _events(spark, sf, ALL).level(level), f"SELECT {_slot_sql(_level, ORIGIN)} AS slot, min(v) AS min, max(v) AS max, count(v) AS count, CAST(sum(v) AS BIGINT) AS sum FROM {_E} GROUP BY 1")
_add("ship_week_revenue", lambda spark, sf: Rollup.build(read_table(spark, sf, "lineitem"), SUM, _cents("l_extendedprice"), "l_shipdate", OLD, NEW).level("week"), f"SELECT {_slot_sql('week', OLD)} AS slot, CAST(sum(v) AS BIGINT) AS sum FROM {_L} GROUP BY 1")
_add("ship_year_quantity", lambda spark, sf: Rollup.build(read_table(spark, sf, "lineitem"), SUM, F.col("l_quantity").cast("long"), "l_shipdate", OLD, NEW).level("year"), f"SELECT {_slot_sql('year', OLD)} AS slot, CAST(sum(q) AS BIGINT) AS sum FROM {_L} GROUP BY 1")
_add("orders_daily_minmax", lambda spark, sf: Rollup.build(read_table(spark, sf, "orders"), MINMAX, _cents("o_totalprice"), "o_orderdate", OLD, NEW).level("day"), f"SELECT {_slot_sql('day', OLD)} AS slot, min(v) AS min, max(v) AS max FROM {_O} GROUP BY 1")

_add("slot_at", lambda spark, sf: _events(spark, sf).at("hour", 5).select("slot", "value"), f"SELECT {WATERMARK - 6 * HOUR}::BIGINT AS slot, CAST(coalesce(sum(v), 0) AS BIGINT) AS value FROM {_E} WHERE s >= {WATERMARK - 6 * HOUR} AND s < {WATERMARK - 5 * HOUR}")
_add("slot_index_range", lambda spark, sf: _events(spark, sf).slots("day", 2, 9).select("slot", "value"), f"SELECT w AS slot, CAST(coalesce(sum(v), 0) AS BIGINT) AS value FROM range({WATERMARK - 9 * DAY}, {WATERMARK - 2 * DAY}, {DAY}) t(w) LEFT JOIN {_E} ON s - s % {DAY} = w GROUP BY w")
_add("last_n_slots", lambda spark, sf: _events(spark, sf).last("day", 10).select("value"), f"SELECT CAST(sum(v) AS BIGINT) AS value FROM {_E} WHERE s >= {WATERMARK - 10 * DAY}")
_add("open_rotation", lambda spark, sf: _events(spark, sf, end=WATERMARK - 5000).total("hour").select("value"), f"SELECT CAST(coalesce(sum(v), 0) AS BIGINT) AS value FROM {_E} WHERE s >= {WATERMARK - DAY} AND s < {WATERMARK - 5000}")
_add("filtered_slots_combine", lambda spark, sf: _events(spark, sf, ALL).filtered("hour", ORIGIN, WATERMARK, F.col("count") >= 3).select("min", "max", "count", "sum"), f"SELECT min(mi) AS min, max(ma) AS max, CAST(sum(c) AS BIGINT) AS count, CAST(sum(t) AS BIGINT) AS sum FROM (SELECT min(v) mi, max(v) ma, count(*) c, sum(v) t FROM {_E} GROUP BY s - s % 3600 HAVING count(*) >= 3) HAVING count(*) > 0")
for _label, _r, _n in (("drop", Retention("drop"), 23), ("limit", Retention("limit", 10), 34), ("keep", Retention("keep"), 1000)):
    _add(f"retention_{_label}", lambda spark, sf, r=_r: _events(spark, sf).with_retention(hour=r).level("hour"), f"SELECT s - s % 3600 AS slot, CAST(sum(v) AS BIGINT) AS sum FROM {_E} WHERE s >= {WATERMARK} - {_n} * 3600 GROUP BY 1")


def _sliding_sql(size: int, slide: int, origin: int, watermark: int, sql: str) -> str:
    return f"SELECT w AS window_start, w + {size} AS window_end, {sql} FROM range({origin}, {watermark - size + 1}, {slide}) t(w) LEFT JOIN {_E} e ON s >= w AND s < w + {size} GROUP BY w"


for _label, _size, _slide, _name in (("1h_10m", HOUR, 600, "sum"), ("10m_3m_uneven", 600, 180, "sum"), ("1h_25m_min", HOUR, 1500, "min"), ("6h_1h_avg", 6 * HOUR, HOUR, "avg"), ("1d_1h_all", DAY, HOUR, "all")):
    _spec, _out, _sql = _LOWER[_name]
    _to = WATERMARK
    _add(f"sliding_{_label}", lambda spark, sf, spec=_spec, out=_out, size=_size, slide=_slide, to=_to: windows.sliding(read_table(spark, sf, "events"), spec, _cents(), "ts", size, slide, ORIGIN, to).selectExpr("window_start", "window_end", *out), _sliding_sql(_size, _slide, ORIGIN, _to, _sql))
_add(
    "tumbling_unaligned_90s",
    lambda spark, sf: windows.tumbling(read_table(spark, sf, "events"), SUM, _cents(), "ts", 90, ORIGIN + 30, WATERMARK).select("window_start", "window_end", "value"),
    f"SELECT w AS window_start, w + 90 AS window_end, CAST(coalesce(sum(v), 0) AS BIGINT) AS value FROM range({ORIGIN + 30}, {WATERMARK - 89}, 90) t(w) LEFT JOIN {_E} e ON s - (s - {ORIGIN + 30}) % 90 = w GROUP BY w",
)
_add(
    "windows_fired_by_advance",
    lambda spark, sf: windows.sliding(read_table(spark, sf, "events"), SUM, _cents(), "ts", HOUR, 600, ORIGIN, END, since=START).select("window_start", "window_end", "value"),
    f"SELECT * FROM ({_sliding_sql(HOUR, 600, ORIGIN, END, 'CAST(coalesce(sum(v), 0) AS BIGINT) AS value')}) WHERE window_end > {START}",
)
_add("tumbling_1d_by_type", lambda spark, sf: windows.tumbling(read_table(spark, sf, "events"), SUM, _cents(), "ts", DAY, ORIGIN, WATERMARK, ["event_type"]).select("event_type", "window_start", "window_end", "value"), f"SELECT k.event_type, w AS window_start, w + {DAY} AS window_end, CAST(coalesce(sum(v), 0) AS BIGINT) AS value FROM range({ORIGIN}, {WATERMARK}, {DAY}) t(w) CROSS JOIN (SELECT DISTINCT event_type FROM events) k LEFT JOIN {_E} e ON s - s % {DAY} = w AND e.event_type = k.event_type GROUP BY ALL")


def _session_sql(keys: str, timeout: int, closed: str | None = None) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    k = f"{keys}, " if keys else ""
    return f"""WITH a AS (SELECT {k}s, v, CASE WHEN s - lag(s) OVER ({part}ORDER BY s) <= {timeout} THEN 0 ELSE 1 END AS new FROM {_E}),
b AS (SELECT *, sum(new) OVER ({part}ORDER BY s RANGE UNBOUNDED PRECEDING) AS n FROM a)
SELECT {k}min(s) AS window_start, max(s) + {timeout} AS window_end, CAST(sum(v) AS BIGINT) AS value FROM b GROUP BY {k}n HAVING {closed or f"max(s) + {timeout} + 1 <= {WATERMARK}"}"""


for _label, _timeout, _keys in (("10m", 600, []), ("30s", 30, []), ("1h_by_user", HOUR, ["user_id"]), ("3d_by_user", 3 * DAY, ["user_id"])):
    _add(f"session_{_label}", lambda spark, sf, t=_timeout, k=_keys: windows.sessions(read_table(spark, sf, "events"), SUM, _cents(), "ts", t, ORIGIN, WATERMARK, k).select(*k, "window_start", "window_end", "value"), _session_sql(", ".join(_keys), _timeout))

for _label, _spec, _by, _desc, _sql in (("desc", SUM, "value", True, "CAST(sum(v) AS BIGINT)"), ("asc", SUM, "value", False, "CAST(sum(v) AS BIGINT)"), ("all_inner", ALL, "count", True, "count(*)")):
    _add(f"topn_users_{_label}", lambda spark, sf, spec=_spec, by=_by, desc=_desc: sets.top_n(_events(spark, sf, spec, ("user_id",)), 10, START, END, desc, by).select("rank", "user_id", F.col(by).alias("value")), f"SELECT CAST(row_number() OVER (ORDER BY x {'DESC' if _desc else 'ASC'}, user_id) AS INTEGER) AS rank, user_id, x AS value FROM (SELECT user_id, {_sql} AS x FROM {_E} WHERE s >= {START} AND s < {END} GROUP BY 1) QUALIFY rank <= 10")
_add("topn_truncated", lambda spark, sf: sets.top_n(_events(spark, sf, SUM, ("user_id",)), 5, ORIGIN, WATERMARK, truncate_per_slot="day").select("rank", "user_id", "value"), f"WITH d AS (SELECT s - s % {DAY} AS d, user_id, sum(v) AS x FROM {_E} GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY d ORDER BY x DESC, user_id) <= 5), t AS (SELECT user_id, CAST(sum(x) AS BIGINT) AS value FROM d GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY value DESC, user_id) AS INTEGER) AS rank, user_id, value FROM t QUALIFY rank <= 5")


def _with_slot(spark: SparkSession, sf: str, level: str) -> tuple[DataFrame, object]:
    e = read_table(spark, sf, "events")
    return e, slot_of(second_of(e, "ts"), level, ORIGIN)


_add("distinct_users_by_day", lambda spark, sf: sets.counted(sets.bitmaps(*_with_slot(spark, sf, "day"), "user_id")), f"SELECT s - s % {DAY} AS slot, CAST(count(DISTINCT user_id) AS BIGINT) AS n_distinct FROM {_E} GROUP BY 1")
_add("distinct_users_by_week", lambda spark, sf: sets.counted(sets.united(sets.bitmaps(*_with_slot(spark, sf, "hour"), "user_id"), slot_of(F.col("slot"), "week", ORIGIN))), f"SELECT {_slot_sql('week', ORIGIN)} AS slot, CAST(count(DISTINCT user_id) AS BIGINT) AS n_distinct FROM {_E} GROUP BY 1")
_add("bitmap_membership", lambda spark, sf: sets.members(sets.bitmaps(*_with_slot(spark, sf, "hour"), "user_id"), read_table(spark, sf, "events"), "user_id"), f"SELECT DISTINCT s - s % 3600 AS slot, user_id AS value FROM {_E}")
_add("bloom_membership", lambda spark, sf: sets.may_contain(sets.blooms(*_with_slot(spark, sf, "hour"), "user_id"), read_table(spark, sf, "events"), "user_id"))


def _bloom_misses(spark: SparkSession, sf: str) -> DataFrame:
    """How many pairs of hour and user there are, and how many of them the hours' filters deny: none. A null user is a pair's, but in no set, so none is denied. Pairs and hits are added up, not joined: Spark takes hits, which are exploded, for few."""
    e, slot = _with_slot(spark, sf, "hour")
    there = e.select(slot.alias("slot"), F.col("user_id").alias("value"), F.lit(True).alias("there"), F.lit(False).alias("hit"))
    found = sets.may_contain(sets.blooms(e, slot, "user_id"), e, "user_id").select("slot", "value", F.lit(False).alias("there"), F.lit(True).alias("hit"))
    pairs = there.unionByName(found).groupBy("slot", "value").agg(F.bool_or("there").alias("there"), F.bool_or("hit").alias("hit")).where("there")
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(~F.col("hit") & F.col("value").isNotNull()).alias("n_missed"))


_add("bloom_misses", _bloom_misses, f"SELECT count(*) AS n_pairs, 0::BIGINT AS n_missed FROM (SELECT DISTINCT s - s % 3600, user_id FROM {_E})")


def _prefix(spark: SparkSession, sf: str) -> DataFrame:
    key = spark.sparkContext.applicationId, sf, "prefix"
    if key not in _STORED:
        _STORED[key] = _stored(spark, sf).prefix("second").stored(scratch(spark, "prefix"))
    return _STORED[key].between(START, END).select("value")


def _merged(spark: SparkSession, sf: str, parts: int = 2) -> Rollup:
    e = read_table(spark, sf, "events")
    one, two = (Rollup.build(e.where(F.col("event_id") % parts == i), ALL, _cents(), "ts", ORIGIN, WATERMARK) for i in (0, 1))
    return one.merged(two)


_add("prefix_range_sum", _prefix, f"SELECT CAST(sum(v) AS BIGINT) AS value FROM {_E} WHERE s >= {START} AND s < {END}")
_add("inverse_landmark_sum", lambda spark, sf: _stored(spark, sf).combine_range(ORIGIN + 10, WATERMARK - 10, use_inverse=True).select("value"), f"SELECT CAST(sum(v) AS BIGINT) AS value FROM {_E} WHERE s >= {ORIGIN + 10} AND s < {WATERMARK - 10}")
_add("merge_two_halves", lambda spark, sf: _merged(spark, sf).level("hour"), f"SELECT s - s % 3600 AS slot, min(v) AS min, max(v) AS max, count(v) AS count, CAST(sum(v) AS BIGINT) AS sum FROM {_E} GROUP BY 1")
_add("advance", lambda spark, sf: _events(spark, sf, end=START).advanced(read_table(spark, sf, "events"), _cents(), "ts", END).level("day"), f"SELECT s - s % {DAY} AS slot, CAST(sum(v) AS BIGINT) AS sum FROM {_E} WHERE s < {END} GROUP BY 1")


def _stored_steps(spark: SparkSession, sf: str) -> Rollup:
    """A snapshot up to START and two steps after it, each stored on its own path; the three paths are one roll-up."""
    key = spark.sparkContext.applicationId, sf, "steps"
    if key not in _STORED:
        e, r, paths = read_table(spark, sf, "events"), _events(spark, sf, end=START), [scratch(spark, "snapshot")]
        r.stored(paths[0])
        for upto in (START + 5 * DAY, END):
            new = r.step(e, _cents(), "ts", upto)
            paths.append(scratch(spark, "step"))
            new.stored(paths[-1])
            r = Rollup.load(spark, paths, SUM, ORIGIN, upto)
        _STORED[key] = r
    return _STORED[key]


_DAYS = f"SELECT s - s % {DAY} AS slot, CAST(sum(v) AS BIGINT) AS sum FROM {_E} WHERE s < {END} GROUP BY 1"
_add("stored_advance", lambda spark, sf: _stored_steps(spark, sf).level("day"), _DAYS)
_add(
    "stored_advance_range",
    lambda spark, sf: _stored_steps(spark, sf).combine_range(START - 1000, END - 77).select("value"),
    f"SELECT CAST(sum(v) AS BIGINT) AS value FROM {_E} WHERE s >= {START - 1000} AND s < {END - 77}",
)
_add(
    "delta_state",
    lambda spark, sf: _events(spark, sf).deltas().groupBy((F.col("slot") - F.col("slot") % 3600).alias("hour")).agg(F.count(F.lit(1)).alias("seconds"), F.count("sum").alias("filled"), F.coalesce(F.sum("sum"), F.lit(0)).alias("value")),
    f"SELECT w - w % 3600 AS hour, count(DISTINCT w) AS seconds, count(DISTINCT s) AS filled, CAST(coalesce(sum(v), 0) AS BIGINT) AS value FROM range({ORIGIN}, {WATERMARK}) t(w) LEFT JOIN {_E} ON s = w GROUP BY 1",
)
_HOURS = f"SELECT s - s % 3600 AS slot, CAST(sum(v) AS BIGINT) AS sum FROM {_E} GROUP BY 1"
_add("delta_rebuild", lambda spark, sf: Rollup.from_deltas(_events(spark, sf).deltas(), SUM, ORIGIN, WATERMARK).level("hour"), _HOURS)


def _appended(spark: SparkSession, sf: str) -> DataFrame:
    """Two change logs, of the events before and after a time, one after the other."""
    old, new = _events(spark, sf, end=START), _events(spark, sf, start=START)
    return Rollup.from_deltas(old.deltas().unionByName(new.deltas()), SUM, ORIGIN, WATERMARK).level("hour")


def _one_more_key(spark: SparkSession, sf: str) -> DataFrame:
    """A keyed roll-up without user 7, and that user's change log merged into it."""
    all_users = _events(spark, sf, keys=("user_id",))
    rest, log = all_users.where_key(F.col("user_id") != 7), all_users.where_key(F.col("user_id") == 7).deltas()
    return rest.with_deltas(log).landmark(keyed=True).select("user_id", "value")


_add("delta_append", _appended, _HOURS)
_add("keyed_merge_delta", _one_more_key, f"SELECT user_id, CAST(sum(v) AS BIGINT) AS value FROM {_E} GROUP BY 1")
_add("cleared_and_merged", lambda spark, sf: _events(spark, sf).cleared().merged(_events(spark, sf)).level("hour"), _HOURS)
_OPEN = WATERMARK - 5000
_add(
    "rotation_hour",
    lambda spark, sf: _events(spark, sf, end=_OPEN).rotation("hour").select("level", "rotation_count", "ticks_remaining", "value"),
    f"SELECT 'hour' AS level, ({_OPEN} % {DAY} // {HOUR})::BIGINT AS rotation_count, 24 - ({_OPEN} % {DAY} // {HOUR})::BIGINT AS ticks_remaining, CAST(coalesce(sum(v), 0) AS BIGINT) AS value FROM {_E} WHERE s >= {_OPEN - _OPEN % DAY} AND s < {_OPEN}",
)
_add(
    "timer_once",
    lambda spark, sf: _events(spark, sf).once(START, DAY).select("at", "value"),
    f"SELECT {START}::BIGINT AS at, CAST(coalesce(sum(v), 0) AS BIGINT) AS value FROM {_E} WHERE s >= {START - DAY} AND s < {START}",
)


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    # a pattern may match a file or a folder; a plain path of a stream must be a folder
    return spark.readStream.schema(read_table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")


def _run(stream: DataFrame) -> DataFrame:
    """All that a stream emits until its source is read: written as Parquet, and read."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def _stream_rollup(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark, "stream")
    streams.roll_up_stream(_stream(spark, sf), SUM, _cents(), "ts", f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return streams.load_roll_up(spark, f"{out}/rows", SUM, ORIGIN, WATERMARK).level("hour")


# a stream's watermark ends at its newest event: windows that end by then are emitted, empty ones aren't
_SEEN = f"(SELECT max(s) FROM {_E})"
for _label, _size, _slide in (("tumbling_1d", DAY, DAY), ("sliding_6h_1h", 6 * HOUR, HOUR)):
    _add(
        f"stream_{_label}",
        lambda spark, sf, size=_size, slide=_slide: _run(streams.window_stream(_stream(spark, sf), SUM, _cents(), "ts", size, slide, ORIGIN).select("window_start", "window_end", "value")),
        f"SELECT w AS window_start, w + {_size} AS window_end, CAST(sum(v) AS BIGINT) AS value FROM range({ORIGIN}, {WATERMARK}, {_slide}) t(w) JOIN {_E} e ON s >= w AND s < w + {_size} WHERE w + {_size} <= {_SEEN} GROUP BY w",
    )
_add(
    "stream_session_1h_by_user",
    lambda spark, sf: _run(streams.session_stream(_stream(spark, sf), SUM, _cents(), "ts", HOUR, keys=["user_id"]).select("user_id", "window_start", "window_end", "value")),
    _session_sql("user_id", HOUR, f"max(s) + {HOUR} <= {_SEEN}"),
)
_add("stream_rollup_hour", _stream_rollup, _HOURS)


def _replay(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    e = e.withColumn("arrival_ms", (second_of(e, "ts") + F.col("event_id") * 7919 % 600) * 1000)
    return Rollup.build(on_time(e, "ts", "arrival_ms", 60, 240), COUNT, _cents(), "ts", ORIGIN, WATERMARK).level("day")


_add("late_drop_replay", _replay, f"SELECT s - s % {DAY} AS slot, count(*) AS count FROM (SELECT *, s + event_id * 7919 % 600 AS a FROM {_E}) WHERE s >= a - a % 60 - 240 GROUP BY 1")
_add("timer_repeat_6h", lambda spark, sf: _events(spark, sf).at_times(ORIGIN + 6 * HOUR, 6 * HOUR, DAY).select("at", "value"), f"SELECT w AS at, CAST(coalesce(sum(v), 0) AS BIGINT) AS value FROM range({ORIGIN + 6 * HOUR}, {WATERMARK + 1}, {6 * HOUR}) t(w) LEFT JOIN {_E} ON s >= w - {DAY} AND s < w GROUP BY w")
_K = "SELECT user_id, CAST(sum(v) AS BIGINT) AS value FROM {0} WHERE {1} GROUP BY 1"
_add("keyed_point", lambda spark, sf: _events(spark, sf, keys=("user_id",)).where_key(F.col("user_id") == 7).landmark().select("value"), f"SELECT CAST(sum(v) AS BIGINT) AS value FROM {_E} WHERE user_id = 7")
_add("keyed_interval", lambda spark, sf: _events(spark, sf, keys=("user_id",)).where_key(F.col("user_id").between(3, 40)).interval(7 * DAY, keyed=True).select("user_id", "value"), _K.format(_E, f"user_id BETWEEN 3 AND 40 AND s >= {WATERMARK - 7 * DAY}"))
_add("keyed_range_time", lambda spark, sf: _events(spark, sf, keys=("user_id",)).where_key(F.col("user_id").between(3, 40)).combine_range(START, END).select("value"), f"SELECT CAST(sum(v) AS BIGINT) AS value FROM {_E} WHERE user_id BETWEEN 3 AND 40 AND s >= {START} AND s < {END}")
_add("keyed_topk", lambda spark, sf: _events(spark, sf, keys=("user_id",)).top_k(7).select("user_id", "value"), f"SELECT user_id, CAST(sum(v) AS BIGINT) AS value FROM {_E} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
_add("keyed_topk_time", lambda spark, sf: _events(spark, sf, keys=("event_type",)).top_k(3, START, END).select("event_type", "value"), f"SELECT event_type, CAST(sum(v) AS BIGINT) AS value FROM {_E} WHERE s >= {START} AND s < {END} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
_add("star_landmark", lambda spark, sf: _events(spark, sf, keys=("user_id",)).star().landmark().select("value"), f"SELECT CAST(sum(v) AS BIGINT) AS value FROM {_E}")
_TWO = of_attributes(quantity=("q", AVG), price=("v", AVG))


def _two_averages(spark: SparkSession, sf: str) -> DataFrame:
    both = F.struct(F.col("l_quantity").cast("long").alias("q"), _cents("l_extendedprice").alias("v"))
    years = Rollup.build(read_table(spark, sf, "lineitem"), _TWO, both, "l_shipdate", OLD, NEW).level("year")
    return years.withColumn("value", _TWO.lowered()).selectExpr("slot", "round(value.quantity, 6) AS quantity", "round(value.price, 6) AS price")


_add("custom_agg_two_attr", _two_averages, f"SELECT {_slot_sql('year', OLD)} AS slot, round(sum(q)::DOUBLE / count(*), 6) AS quantity, round(sum(v)::DOUBLE / count(*), 6) AS price FROM {_L} GROUP BY 1")
