"""Questions read the events of their seconds, and stored levels by their slots: the scans' pushed filters bound them."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tidegauge import queries as q
from tidegauge.functions.aggregates import SUM
from tidegauge.operators import windows
from tidegauge.operators.rollup import Retention
from tidegauge.sources.events import read_table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
DAY, A, B = 86_400, q.START, q.END
LATE = q.WATERMARK - 5000


def filters(df, column):
    """For each scan the bounds of a column that reach Parquet, as text."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [{m[0]: m[1] for m in re.findall(rf"(GreaterThanOrEqual|LessThan)\({column},([^)]*)\)", x)} for x in re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan)]


def stamp(second):
    from datetime import UTC, datetime

    return datetime.fromtimestamp(second, UTC).strftime("%Y-%m-%dT%H:%M")


ASKED = {
    "range": (lambda r: r.range(A, A + 5000, "second"), A, A + 5000),
    "range of hours": (lambda r: r.range(A - A % 3600, A - A % 3600 + 7200, "hour"), A - A % 3600, A - A % 3600 + 7200),
    "group_by": (lambda r: r.group_by(A - A % 900, B, 900), A - A % 900, B + 900 - B % 900),
    "slots": (lambda r: r.slots("day", 2, 9), q.WATERMARK - 9 * DAY, q.WATERMARK - 2 * DAY),
    "at": (lambda r: r.at("hour", 5), q.WATERMARK - 6 * 3600, q.WATERMARK - 5 * 3600),
    "last": (lambda r: r.last("day", 10), q.WATERMARK - 10 * DAY, q.WATERMARK),
    "filtered": (lambda r: r.filtered("hour", q.ORIGIN + DAY, q.ORIGIN + 2 * DAY, F.col("sum") > 0), q.ORIGIN + DAY, q.ORIGIN + 2 * DAY),
    "total": (lambda r: r.total("week"), q.ORIGIN, q.WATERMARK),
    "at_times": (lambda r: r.at_times(q.ORIGIN + 20 * DAY, DAY, DAY), q.ORIGIN + 19 * DAY, None),
    "combine_range": (lambda r: r.combine_range(A, B), A, B),
    "retention": (lambda r: r.with_retention(hour=Retention("drop")).level("hour"), q.WATERMARK - 23 * 3600, q.WATERMARK),
    "once": (lambda r: r.once(A, DAY), A - DAY, A),
}


@pytest.mark.parametrize("name", ASKED)
def test_events(spark, name):
    ask, start, end = ASKED[name]
    found = filters(ask(q._events(spark, SF)), "ts")
    assert found
    for f in found:
        assert stamp(start) in f["GreaterThanOrEqual"] if start is not None else f
        assert "LessThan" in f and (end is None or stamp(end) in f["LessThan"])


@pytest.mark.parametrize("name", ["range", "slots", "last", "filtered", "combine_range", "retention"])
def test_stored_levels(spark, name):
    r = q._stored(spark, SF)
    found = filters(ASKED[name][0](r), "slot")
    assert found and all({"GreaterThanOrEqual", "LessThan"} <= set(f) for f in found)
    read = ASKED[name][0](r).inputFiles()
    assert read and all("rollup-sum" in f for f in read)


def test_open_rotation(spark):
    (f,) = filters(q._events(spark, SF, end=LATE).total("hour"), "ts")
    assert stamp(LATE - LATE % DAY) in f["GreaterThanOrEqual"]


def test_windows(spark):
    e = read_table(spark, SF, "events")
    for df, start, end in (
        (windows.sliding(e, SUM, q._cents(), "ts", 3600, 600, A, B), A, B),
        (windows.sliding(e, SUM, q._cents(), "ts", 3600, 600, q.ORIGIN, B, since=A), None, B),
        (windows.sessions(e, SUM, q._cents(), "ts", 600, A, B), A, B),
    ):
        found = filters(df, "ts")
        assert found and all((start is None or stamp(start) in f["GreaterThanOrEqual"]) and stamp(end) in f["LessThan"] for f in found)


def test_sessions_scan_once(spark):
    """Runs that end inside a day and those at its edges come from the same exchange."""
    df = windows.sessions(read_table(spark, SF, "events"), SUM, q._cents(), "ts", 600, A, B)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_prefix_reads_units(spark):
    r = q._stored(spark, SF)
    p = r.prefix("second").stored(q.scratch(spark, "prefix"))
    bounds = [f for f in filters(p.between(A, B), "slot") if f]
    assert len(bounds) == 2 and {x for f in bounds for x in f.values()} == {str(A - A % 3600), str(A), str(B - B % 3600), str(B)}
    assert p.between(A, B).collect()[0].value == r.combine_range(A, B).collect()[0].value


def test_many_ranges_read_stored_levels(spark):
    df = q._many(q._stored(spark, SF), q.random_ranges("hour", 50))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert all("rollup-sum" in f for f in df.inputFiles()) and "NestedLoop" not in plan and "Cartesian" not in plan


def test_membership_joins_on_the_element(spark):
    for name in ("bitmap_membership", "bloom_membership"):
        plan = q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        joins = re.findall(r"(?:HashJoin|SortMergeJoin) \[([^\]]*)\]", plan)
        assert joins and all(len(j.split(",")) == 2 for j in joins)
