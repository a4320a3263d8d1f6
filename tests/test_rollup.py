"""Golden cases of roll-ups, windows, sets and keys."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.aggregates import ALL, AVG, COUNT, MIN, MINMAX, SUM
from tidegauge.operators import sets, windows
from tidegauge.operators.rollup import Retention, Rollup

DAY = 86_400


def events(spark, rows):
    return spark.createDataFrame(rows, "v long, ms long")


def roll(spark, rows, spec, origin, watermark):
    return Rollup.build(events(spark, rows), spec, F.col("v"), "ms", origin, watermark)


def ones(spark, origin, n, spec=SUM):
    e = spark.range(n).select(F.lit(1).cast("long").alias("v"), ((F.col("id") + origin) * 1000).alias("ms"))
    return Rollup.build(e, spec, F.col("v"), "ms", origin, origin + n)


def value(df):
    return df.collect()[0].value


def pairs(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_sparse_seconds(spark):
    r = roll(spark, [(10, 0), (50, 2999)], SUM, 0, 4)
    assert [value(r.interval(n)) for n in (1, 2, 3, 4)] == [0, 50, 50, 60]
    assert pairs(r.range(0, 4, "second"), "slot", "value") == [(0, 10), (1, 0), (2, 50), (3, 0)]
    assert value(r.combine_range(-2, 1)) == 10 and value(r.combine_range(5, 8)) == 0 and value(r.combine_range(2, 9)) == 50
    assert pairs(r.range(5, 8), "slot", "value") == []
    again = Rollup.from_deltas(r.deltas(), SUM, 0, 4)
    assert pairs(r.deltas(), "slot", "sum")[0] == (0, 10) and value(again.landmark()) == 60


def test_three_days_of_ones_stored(spark, tmp_path):
    origin = 1_699_488_000  # 2023-11-09
    r = ones(spark, origin, 3 * DAY).stored(str(tmp_path / "s"))
    assert value(r.combine_range(origin, origin + DAY)) == DAY and value(r.landmark()) == 3 * DAY
    a, b = origin + 15 * 3600 + 50 * 60 + 50, origin + 2 * DAY + 12 * 3600 + 30 * 60 + 45
    assert value(r.combine_range(a, b)) == 160_795 == value(r.combine_range(a, b, use_inverse=True)) == value(r.prefix_range(r.prefix("second"), a, b))
    assert value(r.combine_range(origin + 5, origin + 3 * DAY - 5, use_inverse=True)) == 3 * DAY - 10
    assert r.plan(origin + 5, origin + 3 * DAY - 5, use_inverse=True).kind == "inverse"
    assert [x.value for x in r.group_by(origin, origin + 3 * DAY, 2 * DAY).orderBy("slot").collect()] == [2 * DAY, DAY]
    assert [x.slot for x in r.group_by(origin, origin + 3 * DAY, 2 * DAY).orderBy("slot").collect()] == [origin, origin + 2 * DAY]
    for bad in ((origin, origin, 60), (origin + 9, origin, 60), (origin, origin + 9, 0), (origin + 4 * DAY, origin + 5 * DAY, 60)):
        assert r.group_by(*bad).count() == 0
    kept = r.with_retention(hour=Retention("drop"))
    assert kept.level("hour").count() == 23 and r.with_retention(hour=Retention("limit", 10)).level("hour").count() == 34
    assert pairs(r.at("minute", 3), "slot", "value") == [(origin + 3 * DAY - 240, 60)]
    assert value(r.last("hour", 5)) == 5 * 3600 and value(r.total("hour")) == 0
    more = r.merged(Rollup.load(spark, str(tmp_path / "s"), SUM, origin, origin + 3 * DAY))
    assert value(more.landmark()) == 6 * DAY and value(more.cleared().landmark()) == 0


def test_advance_late_and_merge(spark):
    r = roll(spark, [(1, 5000)], SUM, 0, 10)
    later = r.advanced(events(spark, [(7, 4000), (2, 11_000)]), F.col("v"), "ms", 12)
    assert value(later.landmark()) == 3 and later.watermark == 12
    assert r.advanced(events(spark, []), F.col("v"), "ms", 5) is r
    both = r.merged(roll(spark, [(5, 8000)], SUM, 0, 9))
    assert value(both.landmark()) == 6 and value(both.interval(10)) == 6
    with pytest.raises(ValueError):
        r.merged(roll(spark, [], SUM, 1, 9))


def test_steps_stored_beside_a_snapshot(spark, tmp_path):
    origin, paths = 1_699_488_000, [str(tmp_path / x) for x in "abc"]
    seconds = [(i % 11, (origin + i * 577) * 1000) for i in range(400)]
    e = events(spark, seconds)
    whole = roll(spark, seconds, ALL, origin, origin + 3 * DAY)
    r = roll(spark, seconds, ALL, origin, origin + DAY).stored(paths[0])
    for path, upto in zip(paths[1:], (origin + DAY + 12_345, origin + 3 * DAY), strict=True):
        r.step(e, F.col("v"), "ms", upto).stored(path)
        r = Rollup.load(spark, paths[: paths.index(path) + 1], ALL, origin, upto)
    assert r.appended and r.levels["week"].count() == 3 and r.level("week").count() == 1
    for level in ("second", "hour", "day", "week", "year"):
        assert sorted(map(tuple, r.level(level).collect())) == sorted(map(tuple, whole.level(level).collect()))
    for ask in (
        lambda x: x.combine_range(origin + 77, origin + 2 * DAY + 999),
        lambda x: x.landmark(),
        lambda x: x.group_by(origin, origin + 3 * DAY, 7200),
        lambda x: x.slots("day", 0, 3),
        lambda x: x.last("hour", 30),
        lambda x: x.filtered("hour", origin, origin + 3 * DAY, F.col("count") > 6),
        lambda x: x.at_times(origin + DAY, 3600, DAY),
        lambda x: x.deltas(origin + 2 * DAY),
        lambda x: x.with_retention(hour=Retention("drop")).level("hour"),
    ):
        assert sorted(map(str, ask(r).collect())) == sorted(map(str, ask(whole).collect()))
    # a step writes the new slots only, and late events don't count
    assert spark.read.parquet(f"{paths[2]}/second").agg(F.min("slot")).head()[0] >= origin + DAY + 12_345
    assert whole.step(e, F.col("v"), "ms", origin + DAY).level("second").count() == 0
    assert {x.watermark for x in (r, r.advanced(e, F.col("v"), "ms", origin))} == {origin + 3 * DAY}


def test_sums_of_steps_by_key_prefix_and_inverse(spark):
    rows = [(i % 3, i, i * 1000) for i in range(50)]
    e = spark.createDataFrame(rows, "k int, v long, ms long")
    build = lambda upto, keys=(): Rollup.build(e, SUM, F.col("v"), "ms", 0, upto, keys)
    r, keyed = (build(20, k).advanced(e, F.col("v"), "ms", 30).advanced(e, F.col("v"), "ms", 50) for k in ((), ("k",)))
    assert value(r.combine_range(3, 41)) == sum(range(3, 41)) == value(r.prefix("second").between(3, 41)) == value(r.combine_range(3, 41, use_inverse=True))
    assert pairs(keyed.landmark(keyed=True), "k", "value") == [(k, sum(range(k, 50, 3))) for k in range(3)]
    assert value(keyed.star().landmark()) == sum(range(50)) and keyed.star().level("minute").count() == 1
    assert [x.value for x in sets.top_n(keyed, 2, 0, 50, truncate_per_slot="minute").orderBy("rank").collect()] == sorted((sum(range(k, 50, 3)) for k in range(3)), reverse=True)[:2]


def test_aggregates_of_nothing_and_nulls(spark):
    for spec, want in ((SUM, 0), (COUNT, 0), (MIN, None), (AVG, None)):
        assert value(roll(spark, [], spec, 0, 10).landmark()) == want
    r = roll(spark, [(None, 1000), (4, None), (6, 2000)], ALL, 0, 10)
    x = value(r.landmark())
    assert (x.min, x.max, x["count"], x["sum"], x.avg) == (6, 6, 1, 6, 6.0)
    assert value(roll(spark, [(3, 1), (1, 2), (9, 3)], MINMAX, 0, 10).landmark()) == (1, 9)


def test_filtered(spark):
    r = roll(spark, [(i, i * 1000) for i in range(10)], SUM, 0, 10)
    assert value(r.filtered("second", 0, 10, F.col("sum") >= 7)) == 24
    assert r.filtered("second", 0, 10, F.col("sum") >= 70).count() == 0


BASE = 1_533_081_600
WINDOWS = [
    ("tumbling", 30, 30, [(100, 5000), (200, 15_000), (300, 25_000), (400, 35_000), (500, 45_000)], 60, [600, 900], [100, 400]),
    ("gap", 120, 120, [(100, 30_000), (200, 90_000), (300, 150_000), (400, 270_000), (500, 330_000)], 360, [300, 300, 900], [100, 300, 400]),
    ("sliding", 60, 10, [(1, 9000), (1, 15_000), (1, 25_000), (1, 35_000), (1, 59_000), (3, 69_000), (5, 75_000), (10, 110_000)], 130, [5, 7, 11, 10, 9, 9, 18, 15], [1, 1, 1, 1, 1, 1, 3, 5]),
    ("uneven", 10, 3, [(i, i * 1000 - 1) for i in range(1, 23)], 22, [55, 85, 115, 145, 175], [1, 4, 7, 10, 13]),
    ("boundary", 10, 10, [(100, 9999), (200, 10_000), (300, 10_001)], 10, [100], [100]),
    ("empty", 10, 10, [], 10, [0], [None]),
]


@pytest.mark.parametrize(("size", "slide", "rows", "watermark", "total", "least"), [w[1:] for w in WINDOWS], ids=[w[0] for w in WINDOWS])
def test_windows(spark, size, slide, rows, watermark, total, least):
    e = events(spark, [(v, BASE * 1000 + ms) for v, ms in rows])
    for spec, want in ((SUM, total), (MIN, least)):
        got = windows.sliding(e, spec, F.col("v"), "ms", size, slide, BASE, BASE + watermark).orderBy("window_start").collect()
        assert [x.value for x in got] == want
        assert [x.window_start for x in got] == [BASE + i * slide for i in range(len(want))]


def test_window_needs_a_slide_within_its_size(spark):
    with pytest.raises(ValueError):
        windows.sliding(events(spark, []), SUM, F.col("v"), "ms", 5, 10, 0, 10)


@pytest.mark.parametrize(
    ("timeout", "rows", "watermark", "want"),
    [
        (10, [(100, 1), (200, 5), (300, 8), (150, 20), (250, 25), (500, 40)], 51, [(1, 18, 600), (20, 35, 400), (40, 50, 500)]),
        (5, [(100, 1), (200, 3), (300, 10), (400, 12), (500, 20)], 26, [(1, 8, 300), (10, 17, 700), (20, 25, 500)]),
        (5, [(100, 1)], 6, []),
        (5, [(1, 86_399), (2, 86_401), (3, 86_406), (4, 200_000)], 86_412, [(86_399, 86_411, 6)]),
        (5, [], 60, []),
    ],
)
def test_sessions(spark, timeout, rows, watermark, want):
    e = events(spark, [(v, s * 1000 + 7) for v, s in rows])
    assert pairs(windows.sessions(e, SUM, F.col("v"), "ms", timeout, 0, watermark), "window_start", "window_end", "value") == want


def test_top_n_and_keys(spark):
    rows = [(1, 10, 1), (2, 50, 1), (3, 30, 1), (1, 100, 2), (2, 10, 2), (3, 20, 2), (4, 15, 2), (5, 1, 2), (6, 5000, 2)]
    e = spark.createDataFrame([(k, v, s * 1000) for k, v, s in rows], "k int, v long, ms long")
    r = Rollup.build(e, SUM, F.col("v"), "ms", 0, 3, ["k"])
    assert [x.value for x in sets.top_n(r, 10, 1, 2, descending=False).orderBy("rank").collect()] == [10, 30, 50]
    assert [x.value for x in sets.top_n(r, 10, 1, 3, descending=False).orderBy("rank").collect()] == [1, 15, 50, 60, 110, 5000]
    assert [(x.k, x.value) for x in sets.top_n(r, 1, 1, 3, truncate_per_slot="second").collect()] == [(6, 5000)]
    assert [x.k for x in r.top_k(2).collect()] == [6, 1]
    assert value(r.star().landmark()) == sum(v for _, v, _ in rows) == value(r.where_key(F.col("k") > 0).landmark())
    assert value(r.where_key(F.col("k").between(1, 2)).combine_range(2, 3)) == 110


@pytest.mark.parametrize("make", ["bitmaps", "blooms"])
def test_membership(spark, make):
    rows = [(65, 1), (72, 2), (88, 3), (63, 6), (95, 7), (77, 9)]
    e = spark.createDataFrame(rows, "value int, s long").where("value >= 70").withColumn("x", F.col("s") + 100_000)
    maps = getattr(sets, make)(e, F.floor(F.col("s") / 4) * 4, "x")
    find = sets.members if make == "bitmaps" else sets.may_contain
    want = [(0, 100_002), (0, 100_003), (4, 100_007), (8, 100_009)]
    assert pairs(find(maps, spark.range(100_000, 100_012), "id"), "slot", "value") == want
    whole = sets.united(maps).withColumn("slot", F.lit(0))
    assert [v for _, v in pairs(find(whole, spark.range(100_000, 100_012), "id"), "slot", "value")] == [v for _, v in want]


def test_timers(spark):
    r = roll(spark, [(250, i * 1000) for i in range(1, 8)], SUM, 0, 10)
    assert pairs(r.at_times(5, 5, 10), "at", "value") == [(5, 1000), (10, 1750)]


@pytest.mark.parametrize(("parts", "words"), [(8, 4), (1, 1), (2, 1), (1, 4)])
def test_bloom_hits_meet_by_position(spark, monkeypatch, parts, words):
    """Full filters against every candidate: the same hits, false ones too, as a test of each bit, and no broadcast of exploded bits."""
    monkeypatch.setattr(sets, "PARTS", parts, raising=False)
    monkeypatch.setattr(sets, "WORDS", words, raising=False)
    e = spark.range(70 * 4000).select((F.col("id") % 70 * 3600).alias("slot"), (F.col("id") * 7919 % 1_000_003).alias("x"))
    e = e.unionByName(spark.createDataFrame([(None, 7), (3600, None)], "slot long, x long"))
    filters, candidates = sets.blooms(e, F.col("slot"), "x"), spark.range(1500).select((F.col("id") * 7).alias("x"))
    bits = {}
    for r in filters.collect():
        bits.setdefault(r.slot, np.zeros(sets.BLOOM_BITS, bool))[r.bucket * sets.BITS :][: sets.BITS] = np.unpackbits(np.frombuffer(bytes(r.bitmap), np.uint8), bitorder="little")
    asked = candidates.select("x", sets._positions(F.col("x")).alias("p")).collect()
    want = {(s, r.x) for s, b in bits.items() for r in asked if b[r.p].all()}
    found = sets.may_contain(filters, candidates, "x")
    got = [tuple(r) for r in found.collect()]
    inside = {tuple(r) for r in e.join(candidates, "x").select("slot", "x").collect()}
    assert len(got) == len(set(got)) and set(got) == want > inside
    assert not re.findall(r"Broadcast\w*Join \[bucket", found._jdf.queryExecution().executedPlan().toString())
