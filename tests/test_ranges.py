"""The range planner and durations: golden examples and random properties."""

import random
from datetime import UTC, datetime

import pytest

from tidegauge.functions import duration as d
from tidegauge.plans.ranges import LEVELS, TimeRange, choose, split


def at(*x):
    return int(datetime(*x, tzinfo=UTC).timestamp())


def test_seven_pieces():
    r = TimeRange(at(2023, 11, 9, 15, 50, 50), at(2023, 11, 11, 12, 30, 45))
    assert [(p.level, p.slots) for p in split(r)] == [("second", 10), ("minute", 9), ("hour", 8), ("day", 1), ("hour", 12), ("minute", 30), ("second", 45)]
    plan = choose(r, at(2023, 11, 9), at(2023, 11, 12))
    assert (plan.kind, plan.cost) == ("combined", 122)
    assert sum(p.end - p.start for p in plan.pieces) == 160_795


def test_split_covers_in_order():
    r = random.Random(1)
    for _ in range(20_000):
        a = r.randrange(1_600_000_000)
        b = a + r.choice((r.randrange(300), r.randrange(10**6), 3600 * r.randrange(60), r.randrange(10**9)))
        now = a
        for p in split(TimeRange(a, b)):
            assert p.start == now < p.end and p.start % LEVELS[p.level] == 0 == p.end % LEVELS[p.level]
            now = p.end
        assert now == b


def test_plans():
    assert choose(TimeRange(0, 100), 0, 100).kind == "landmark"
    assert choose(TimeRange(50, 40), 0, 100).kind == "empty"
    assert choose(TimeRange(-5, 1000), 0, 100).kind == "landmark"
    assert choose(TimeRange(3, 50), 0, 100).cost == 47
    assert choose(TimeRange(1, 50_000), 0, 10**6, prefix=True).cost == 1
    assert choose(TimeRange(1, 20_000), 0, 10**6, single_up_to=15_000).kind == "combined"
    assert choose(TimeRange(1, 14_000), 0, 10**6, single_up_to=15_000).kind == "single"
    assert choose(TimeRange(1, 99_999), 0, 100_000, invertible=True, use_inverse=True).kind == "inverse"
    assert choose(TimeRange(1, 99_999), 0, 100_000, invertible=False, use_inverse=True).kind == "combined"


def test_range_errors_and_granularity():
    with pytest.raises(ValueError):
        TimeRange.of_millis(10, 5)
    with pytest.raises(ValueError):
        TimeRange.of_millis(-10, 5)
    assert TimeRange.of_millis(1999, 7_200_999) == TimeRange(1, 7200)
    assert TimeRange(3600, 7200).granularity == "hour" and TimeRange(60, 7200).slots == 119


def test_durations():
    assert d.hours(1.5) == d.minutes(90) and d.years(1) == d.weeks(52)
    assert d.Duration.of(-1, -500_000_000).whole("second") == -1 and d.Duration.of(-1, -500_000_000).subsec("millisecond") == -500
    assert str(d.days(1) + d.hours(2) + d.minutes(3)) == "1d2h3m" and str(d.ZERO) == "0s" and str(d.Duration.of(1.25)) == "1.25s"
    assert d.MAX.checked_add(d.Duration(1)) is None and d.MAX.saturating_add(d.seconds(1)) == d.MAX and abs(d.MIN) == d.MAX.saturating_add(d.seconds(1))
    assert d.seconds(7).checked_div(0) is None and d.seconds(-7) // 2 == d.milliseconds(-3500)
    with pytest.raises(OverflowError):
        d.MAX + d.seconds(1)
