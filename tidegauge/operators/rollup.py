"""Roll-ups: partials per second, minute, hour, day, week and year, and the questions they answer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.aggregates import Aggregate
from tidegauge.functions.duration import Duration
from tidegauge.plans.ranges import LEVELS, Piece, Plan, TimeRange, choose
from tidegauge.sources.events import between, second_of


def slot_of(second: Column, level: str, origin: int) -> Column:
    """The start of the slot that a second is in."""
    size, first = LEVELS[level], origin if level in ("week", "year") else 0
    return second - F.pmod(second - F.lit(first), F.lit(size)) if size > 1 else second


@dataclass(frozen=True)
class Retention:
    """How many of a level's newest slots are kept: drop: one less than its capacity; keep: all; limit: the capacity and `more`."""

    policy: str = "keep"
    more: int = 0


#: Slots of each level before a rotation is full.
CAPACITY = {"second": 60, "minute": 60, "hour": 24, "day": 7, "week": 52, "year": 10}
_COARSER = dict(zip(list(LEVELS)[:-1], list(LEVELS)[1:], strict=True))


@dataclass(frozen=True)
class Rollup:
    """levels: for each level a sparse table (*keys, slot, *fields of the aggregate), slot being the epoch second at which it starts.

    Slots lie between origin and watermark, both whole seconds. Levels are lazy: until stored() has written them, each is one
    aggregation of the events (raw), and a question about some slots or a range scans the events of their seconds only. Filters compare the bare slot or timestamp column, so that they and the columns asked for reach the scan.
    """

    spec: Aggregate
    origin: int
    watermark: int
    levels: dict[str, DataFrame] = field(repr=False)
    keys: tuple[str, ...] = ()
    retention: dict[str, Retention] = field(default_factory=dict)
    raw: tuple[DataFrame, Column, str] | None = field(default=None, repr=False)
    #: Whether a level may hold several partials of a slot (and key), which are combined when they are read.
    appended: bool = False

    # -- building ---------------------------------------------------------------------------

    @classmethod
    def build(cls, events: DataFrame, spec: Aggregate, value: Column, ts: str, origin: int, watermark: int, keys: Sequence[str] = ()) -> Rollup:
        """From raw events. Rows before origin are late, rows at the watermark or beyond wait; rows without a timestamp don't count."""
        raw = events, value, ts
        levels = {level: cls._of_events(raw, spec, origin, watermark, keys, level, origin) for level in LEVELS}
        return cls(spec, origin, watermark, levels, tuple(keys), raw=raw)

    @staticmethod
    def _of_events(raw: tuple[DataFrame, Column, str], spec: Aggregate, start: int, end: int, keys: Sequence[str], level: str, origin: int) -> DataFrame:
        """A level from the events of some seconds."""
        events, value, ts = raw
        rows = between(events, ts, start, max(start, end)).select(*keys, slot_of(second_of(events, ts), level, origin).alias("slot"), value.alias("_in"))
        return rows.groupBy(*keys, "slot").agg(*spec.lifted(F.col("_in")))

    @classmethod
    def _from_seconds(cls, seconds: DataFrame, spec: Aggregate, origin: int, watermark: int, keys: tuple[str, ...]) -> Rollup:
        levels = {"second": seconds}
        for level in list(LEVELS)[1:]:
            levels[level] = cls._coarser(levels, level, spec, origin, keys)
        return cls(spec, origin, watermark, levels, keys)

    @staticmethod
    def _coarser(levels: dict[str, DataFrame], level: str, spec: Aggregate, origin: int, keys: Sequence[str]) -> DataFrame:
        """A level from the coarsest that its slots are made of: weeks and years count from the origin, so from days only if that begins one."""
        names = list(LEVELS)
        finer = names[names.index(level) - 1] if level not in ("week", "year") else "day" if origin % LEVELS["day"] == 0 else "second"
        return levels[finer].withColumn("slot", slot_of(F.col("slot"), level, origin)).groupBy(*keys, "slot").agg(*spec.combined())

    def stored(self, path: str) -> Rollup:
        """A snapshot: every level written under path, in slot order, each from a finer one that is already there, and read again. load() reads it later."""
        spark, done = self._spark, {}
        for level in LEVELS:
            df = self._coarser(done, level, self.spec, self.origin, self.keys) if done else self._combined(self.levels[level])
            df.repartitionByRange("slot").sortWithinPartitions("slot").write.mode("overwrite").parquet(f"{path}/{level}")
            done[level] = spark.read.parquet(f"{path}/{level}")
        return self.load(spark, path, self.spec, self.origin, self.watermark, self.keys)

    @classmethod
    def load(cls, spark: SparkSession, path: str | Sequence[str], spec: Aggregate, origin: int, watermark: int, keys: Sequence[str] = ()) -> Rollup:
        """What stored() has written under path; several paths, of a snapshot and of the steps after it, are one roll-up."""
        paths = [path] if isinstance(path, str) else list(path)
        levels = {level: spark.read.parquet(*[f"{p}/{level}" for p in paths]) for level in LEVELS}
        return cls(spec, origin, watermark, levels, tuple(keys), appended=len(paths) > 1)

    def level(self, name: str) -> DataFrame:
        """A level's retained slots."""
        return self._combined(self._kept(name))

    def _kept(self, name: str) -> DataFrame:
        """The partials of a level's retained slots."""
        return self.levels[name] if self._oldest(name) is None else self._partials(name, self.origin - LEVELS[name], self.watermark)

    def _combined(self, partials: DataFrame) -> DataFrame:
        """A row for each slot (and key)."""
        return partials.groupBy(*self.keys, "slot").agg(*self.spec.combined()) if self.appended else partials

    def _oldest(self, name: str) -> int | None:
        """Where a level's retained slots begin; None if all are."""
        keep = self.retention.get(name, Retention())
        n = {"keep": None, "drop": CAPACITY[name] - 1, "limit": CAPACITY[name] + keep.more}[keep.policy]
        return None if n is None else self._newest(name) - n * LEVELS[name]

    def _rows(self, name: str, start: int, end: int) -> DataFrame:
        """A level's retained slots that begin from start to before end."""
        return self._combined(self._partials(name, start, end))

    def _partials(self, name: str, start: int, end: int) -> DataFrame:
        """The partials of these slots, for those who combine them further; where they aren't stored, from the events of their seconds."""
        size, first = LEVELS[name], self.origin if name in ("week", "year") else 0
        lo, hi = (t + (first - t) % size for t in (start, end))
        oldest = self._oldest(name)
        lo = lo if oldest is None else max(lo, oldest)
        if self.raw is None:
            return self.levels[name].where((F.col("slot") >= lo) & (F.col("slot") < hi))
        return self._of_events(self.raw, self.spec, max(lo, self.origin), min(hi, self.watermark), self.keys, name, self.origin)

    def with_retention(self, **policies: Retention) -> Rollup:
        return replace(self, retention=self.retention | policies)

    def cleared(self) -> Rollup:
        return replace(self, levels={k: v.limit(0) for k, v in self.levels.items()}, raw=None, appended=False)

    def _newest(self, level: str) -> int:
        """The end of the newest complete slot."""
        first = self.origin if level in ("week", "year") else 0
        return self.watermark - (self.watermark - first) % LEVELS[level]

    # -- moving on --------------------------------------------------------------------------

    def step(self, events: DataFrame, value: Column, ts: str, watermark: int) -> Rollup:
        """The roll-up of the events from this one's watermark to a later one alone; late events don't count. Stored beside this one, load() of both paths is the roll-up that has advanced: no old slot is read or written again."""
        new = self._of_events((events, value, ts), self.spec, self.watermark, watermark, self.keys, "second", self.origin)
        return Rollup._from_seconds(new, self.spec, self.origin, max(watermark, self.watermark), self.keys)

    def advanced(self, events: DataFrame, value: Column, ts: str, watermark: int) -> Rollup:
        """With events from the old watermark to the new one; a lower watermark changes nothing, late events don't count."""
        return self if watermark <= self.watermark else self.merged(self.step(events, value, ts, watermark))

    def merged(self, other: Rollup) -> Rollup:
        """Both slot by slot; the later watermark holds. Partials are appended, and those of a slot combined when it is read, so that a step costs nothing for the slots that it doesn't touch."""
        if (self.origin, self.spec.name, self.keys) != (other.origin, other.spec.name, other.keys):
            raise ValueError("only roll-ups of one origin, aggregate and key merge")
        both = {k: v.unionByName(other.levels[k]) for k, v in self.levels.items()}
        return replace(self, levels=both, watermark=max(self.watermark, other.watermark), raw=None, appended=True)

    def deltas(self, since: int | None = None) -> DataFrame:
        """The change log: a row for each second from `since` to the watermark, null fields where nothing came. With keys: the keys' seconds in which something came."""
        start = self.origin if since is None else max(since, self.origin)
        rows = self._rows("second", start, self.watermark)
        if self.keys:
            return rows.select(*self.keys, "slot", *self.spec.fields)
        return self._spine(start, self.watermark, 1).join(rows, "slot", "left").select("slot", *self.spec.fields)

    @classmethod
    def from_deltas(cls, deltas: DataFrame, spec: Aggregate, origin: int, watermark: int, keys: Sequence[str] = ()) -> Rollup:
        """From a change log, or from several united: partials of the same second (and key) are combined."""
        some = deltas.where(" or ".join(f"{n} is not null" for n in spec.fields)).where((F.col("slot") >= origin) & (F.col("slot") < watermark))
        seconds = some.groupBy(*keys, "slot").agg(*spec.combined())
        return cls._from_seconds(seconds, spec, origin, watermark, tuple(keys))

    def with_deltas(self, deltas: DataFrame, watermark: int | None = None) -> Rollup:
        """This and a change log of the same keys, slot by slot: one key's log merges into the keyed roll-up."""
        end = max(self.watermark, watermark or self.watermark)
        return self.merged(Rollup.from_deltas(deltas, self.spec, self.origin, end, self.keys))

    # -- questions --------------------------------------------------------------------------

    def plan(self, start: int, end: int, **options: object) -> Plan:
        return choose(TimeRange(start, end), self.origin, self.watermark, invertible=self.spec.invertible, **options)

    def executed(self, start: int, end: int, **options: object) -> Plan:
        """The plan that combine_range() runs: levels that aren't stored are no cheaper than their events, so there it is a scan of the range's seconds."""
        if not self._scans:
            return self.plan(start, end, **options)
        r = TimeRange(start, end).clipped(self.origin, self.watermark)
        return Plan("scan", (Piece("second", r.start, r.end),), r.duration) if r.duration > 0 else Plan("empty", (), 0)

    @property
    def _scans(self) -> bool:
        return self.raw is not None and not self.retention

    def explain(self, start: int, end: int, **options: object) -> DataFrame:
        """(seq, kind, level, start, end, slots, cost) of the pieces of the plan that combine_range() runs."""
        p = self.executed(start, end, **options)
        rows = [(i, p.kind, x.level, x.start, x.end, x.slots, p.cost) for i, x in enumerate(p.pieces)]
        return self._spark.createDataFrame(rows, "seq int, kind string, level string, start long, end long, slots long, cost long")

    @property
    def _spark(self) -> SparkSession:
        return self.levels["second"].sparkSession

    def _pieces(self, pieces: Sequence) -> DataFrame:
        """The partials of the pieces' slots: one filter for each level, united."""
        parts = []
        for level in dict.fromkeys(p.level for p in pieces):
            cond = None
            for p in pieces:
                if p.level == level:
                    c = (F.col("slot") >= p.start) & (F.col("slot") < p.end)
                    cond = c if cond is None else cond | c
            mine = [p for p in pieces if p.level == level]
            rows = self._partials(level, min(p.start for p in mine), max(p.end for p in mine))
            parts.append(rows.where(cond).select(*self.keys, "slot", *self.spec.fields))
        if not parts:
            return self._partials("second", self.origin, self.origin).select(*self.keys, "slot", *self.spec.fields)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def combine_range(self, start: int, end: int, keyed: bool = False, **options: object) -> DataFrame:
        """One row, or one for each key, with the fields and `value` of all seconds from start to before end; the identity where there is nothing."""
        keys = self.keys if keyed else ()
        if self._scans:
            events, value, ts = self.raw
            r = TimeRange(start, end).clipped(self.origin, self.watermark)
            rows = between(events, ts, r.start, max(r.start, r.end)).withColumn("_in", value)
            return self._lowered(rows.groupBy(*keys).agg(*self.spec.lifted(F.col("_in"))), keys)
        p = self.plan(start, end, **options)
        if p.kind == "inverse":
            whole = self._kept("year").select(*keys, *self.spec.fields)
            out = self._pieces(p.pieces).select(*keys, *[(-F.col(n)).alias(n) for n in self.spec.fields])
            rows = whole.unionByName(out)
        else:
            rows = self._pieces(p.pieces)
        return self._lowered(rows.groupBy(*keys).agg(*self.spec.combined()), keys)

    def analyze(self, start: int, end: int, **options: object) -> DataFrame:
        """combine_range() with the kind of the plan that it runs and its cost in combinations."""
        p = self.executed(start, end, **options)
        return self.combine_range(start, end, **options).withColumns({"kind": F.lit(p.kind), "cost": F.lit(p.cost).cast("long")})

    def stats(self) -> DataFrame:
        """(level, retained, first, newest, full): a level's retained slots, the first and newest of them, and whether a rotation is full."""
        parts = [self.level(n).agg(F.count_distinct("slot").alias("retained"), F.min("slot").alias("first"), F.max("slot").alias("newest")).select(F.lit(n).alias("level"), "retained", "first", "newest", F.lit(self.watermark - self.origin >= CAPACITY[n] * LEVELS[n]).alias("full")) for n in LEVELS]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _lowered(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*keep, *self.spec.filled()).withColumn("value", self.spec.lowered())

    def interval(self, duration: Duration | int, **options: object) -> DataFrame:
        """The last `duration` (whole seconds of it) before the watermark."""
        n = duration.whole("second") if isinstance(duration, Duration) else duration
        return self.combine_range(self.watermark - n, self.watermark, **options)

    def interval_stats(self, duration: Duration | int, **options: object) -> DataFrame:
        """interval() with kind and cost, as analyze() has them."""
        n = duration.whole("second") if isinstance(duration, Duration) else duration
        return self.analyze(self.watermark - n, self.watermark, **options)

    def _spine(self, start: int, end: int, step: int) -> DataFrame:
        return self._spark.range(start, max(start, end), step).select(F.col("id").alias("slot"))

    def range(self, start: int, end: int, level: str | None = None) -> DataFrame:
        """(slot, fields, value) of every slot of a level (the coarsest that both bounds fit) in the range, empty ones with the identity."""
        r = TimeRange(start, end).clipped(self.origin, self.watermark)
        level = level or TimeRange(start, end).granularity
        kept = self._partials(level, r.start, max(r.start, r.end)).groupBy("slot").agg(*self.spec.combined())
        return self._lowered(self._spine(r.start, r.end, LEVELS[level]).join(kept, "slot", "left"), ["slot"])

    def group_by(self, start: int, end: int, interval: int, clip: bool = False) -> DataFrame:
        """(slot, fields, value) of buckets of `interval` seconds from start on; all are there, and the last runs over the end unless clipped. Empty if start isn't before end or lies beyond the watermark, or without an interval."""
        if start >= end or interval <= 0 or start > self.watermark:
            return self._lowered(self._pieces(()), ["slot"])
        last = start + -(-(end - start) // interval) * interval
        level = next(n for n in ("day", "hour", "minute", "second") if start % LEVELS[n] == 0 and interval % LEVELS[n] == 0 and (not clip or end % LEVELS[n] == 0))
        rows = self._partials(level, start, end if clip else last)
        rows = rows.withColumn("slot", F.col("slot") - F.pmod(F.col("slot") - start, F.lit(interval))).groupBy("slot").agg(*self.spec.combined())
        return self._lowered(self._spine(start, last, interval).join(rows, "slot", "left"), ["slot"])

    def landmark(self, keyed: bool = False) -> DataFrame:
        """The whole history, from the coarsest level."""
        keys = self.keys if keyed else ()
        if self._scans:
            return self.combine_range(self.origin, self.watermark, keyed)
        return self._lowered(self._kept("year").groupBy(*keys).agg(*self.spec.combined()), keys)

    def at(self, level: str, i: int) -> DataFrame:
        """The i-th newest complete slot of a level, the newest being 0."""
        return self.slots(level, i, i + 1)

    def slots(self, level: str, i: int, j: int) -> DataFrame:
        """(slot, fields, value) of the newest complete slots with index i to before j, oldest first in time; empty ones with the identity."""
        end, size = self._newest(level), LEVELS[level]
        lo, hi = max(end - j * size, self.origin - (self.origin - (self.origin if level in ("week", "year") else 0)) % size), end - i * size
        rows = self._partials(level, lo, hi).groupBy("slot").agg(*self.spec.combined())
        return self._lowered(self._spine(lo, hi, size).join(rows, "slot", "left"), ["slot"])

    def last(self, level: str, n: int) -> DataFrame:
        """The newest n complete slots of a level as one row."""
        end = self._newest(level)
        return self._lowered(self._partials(level, end - n * LEVELS[level], end).agg(*self.spec.combined()))

    def total(self, level: str) -> DataFrame:
        """A level's open rotation: what has come since the newest slot of the next coarser level was complete."""
        start = max(self.origin, self._newest(_COARSER[level])) if level in _COARSER else self.origin
        return self._lowered(self._partials("second", start, self.watermark).agg(*self.spec.combined()))

    def rotation(self, level: str) -> DataFrame:
        """(level, rotation_count, ticks_remaining, fields, value) of a level's open rotation: complete slots in it, slots until it is full, and its total."""
        size = LEVELS[level]
        start = self._newest(_COARSER[level]) if level in _COARSER else self.origin
        count = min(CAPACITY[level] - 1, max(0, self._newest(level) - start) // size) if level in _COARSER else (self._newest(level) - start) // size % CAPACITY[level]
        head = [F.lit(level).alias("level"), F.lit(count).cast("long").alias("rotation_count"), F.lit(CAPACITY[level] - count).cast("long").alias("ticks_remaining")]
        return self.total(level).select(*head, *self.spec.fields, "value")

    def filtered(self, level: str, start: int, end: int, keep: Column) -> DataFrame:
        """The slots in the range whose partial fits, as one row; no row if none does."""
        rows = self._partials(level, start, end).groupBy("slot").agg(*self.spec.combined()).where(keep)
        return self._lowered(rows.agg(*self.spec.combined(), F.count(F.lit(1)).alias("_n")).where("_n > 0"))

    # -- prefix layout ----------------------------------------------------------------------

    def prefix(self, level: str) -> Prefix:
        """Running totals of a level. They run inside a unit of the second coarser level, and over the units' sums, so no window holds the whole level."""
        if not self.spec.invertible:
            raise ValueError(f"{self.spec.name} can't be subtracted")
        names = list(LEVELS)
        unit = names[min(names.index(level) + 2, len(names) - 1)]
        rows = self._kept(level).groupBy("slot").agg(*self.spec.combined()).withColumn("unit", slot_of(F.col("slot"), unit, self.origin))
        inside = Window.partitionBy("unit").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
        upto = Window.orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
        units = rows.groupBy("unit").agg(*self.spec.combined()).select("unit", *[F.sum(n).over(upto).alias(n) for n in self.spec.fields])
        run = rows.select("slot", *[F.sum(n).over(inside).alias(n) for n in self.spec.fields])
        return Prefix(self, unit, run, units)

    def prefix_range(self, prefix: Prefix, start: int, end: int) -> DataFrame:
        """A range's row from running totals: what runs before the end less what runs before the start."""
        return prefix.between(start, end)

    # -- keys and timers --------------------------------------------------------------------

    def where_key(self, condition: Column) -> Rollup:
        """The roll-up of some keys."""
        raw = self.raw and (self.raw[0].where(condition), *self.raw[1:])
        return replace(self, levels={k: v.where(condition) for k, v in self.levels.items()}, raw=raw)

    def star(self) -> Rollup:
        """The roll-up over all keys, without them."""
        return replace(self, keys=(), levels={k: v.drop(*self.keys) for k, v in self.levels.items()}, appended=True)

    def top_k(self, k: int, start: int | None = None, end: int | None = None, by: str | None = None, descending: bool = True) -> DataFrame:
        """The k keys with the highest value (or lowest) over all time or a range, ties by key."""
        rows = self.landmark(keyed=True) if start is None else self.combine_range(start, end, keyed=True)
        order = F.col(by or "value")
        return rows.orderBy(order.desc_nulls_last() if descending else order.asc_nulls_last(), *self.keys).limit(k)

    def at_times(self, first: int, every: int, back: int) -> DataFrame:
        """Repeated timers: (at, fields, value) of the last `back` seconds at first, first + every, ... up to the watermark.

        A second is within reach of the few times after it: each row of the finest level that fits is dealt to those, no join by range.
        """
        level = next(n for n in ("day", "hour", "minute", "second") if all(x % LEVELS[n] == 0 for x in (first, every, back)))
        if first > self.watermark:
            return self._lowered(self._pieces(()).withColumnRenamed("slot", "at"), ["at"])
        n = (self.watermark - first) // every
        k = lambda c: F.floor((c - first) / every)
        lo, hi = F.greatest(F.lit(0), k(F.col("slot")) + 1), F.least(F.lit(n), k(F.col("slot") + back))
        rows = self._partials(level, first - back, first + n * every).where(lo <= hi).withColumn("_k", F.explode(F.sequence(lo, hi))).groupBy((F.col("_k") * every + first).alias("at")).agg(*self.spec.combined())
        spine = self._spark.range(0, max(0, n + 1)).select((F.col("id") * every + first).alias("at"))
        return self._lowered(spine.join(rows, "at", "left"), ["at"])

    def once(self, at: int, back: int) -> DataFrame:
        """A timer that fires once: (at, fields, value) of the last `back` seconds at the time `at`; no row while the watermark hasn't reached it."""
        if at > self.watermark:
            return self._lowered(self._pieces(()).withColumnRenamed("slot", "at"), ["at"])
        return self.combine_range(at - back, at).select(F.lit(at).cast("long").alias("at"), *self.spec.fields, "value")


@dataclass(frozen=True)
class Prefix:
    """Running totals of a roll-up's level: inside (slot, fields), up to and with each slot of its unit; units (unit, fields), up to and with each unit. Both only have what isn't empty."""

    of: Rollup = field(repr=False)
    unit: str
    inside: DataFrame = field(repr=False)
    units: DataFrame = field(repr=False)

    def stored(self, path: str) -> Prefix:
        """Both tables written under path in order, and read again: a lookup then reads the slots of one unit, by a filter that reaches Parquet, and the few units."""
        spark = self.inside.sparkSession
        self.inside.repartitionByRange("slot").sortWithinPartitions("slot").write.mode("overwrite").parquet(f"{path}/inside")
        self.units.sortWithinPartitions("unit").write.mode("overwrite").parquet(f"{path}/units")
        return replace(self, inside=spark.read.parquet(f"{path}/inside"), units=spark.read.parquet(f"{path}/units"))

    def before(self, t: int, side: str) -> DataFrame:
        """Two rows at most: the total of the units before t's, and that of its own unit's slots before t."""
        size, first = LEVELS[self.unit], self.of.origin if self.unit in ("week", "year") else 0
        start = t - (t - first) % size
        fields = list(self.of.spec.fields)
        units = self.units.where(F.col("unit") < start).agg(*[F.max_by(n, "unit").alias(n) for n in fields])
        own = self.inside.where((F.col("slot") >= start) & (F.col("slot") < t)).agg(*[F.max_by(n, "slot").alias(n) for n in fields])
        return units.unionByName(own).select(F.lit(side).alias("side"), *fields)

    def between(self, start: int, end: int) -> DataFrame:
        r = TimeRange(start, end).clipped(self.of.origin, self.of.watermark)
        rows = self.before(max(r.start, r.end), "end").unionByName(self.before(r.start, "start"))
        total = lambda n, side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(n))), F.lit(0))
        return self.of._lowered(rows.agg(*[(total(n, "end") - total(n, "start")).alias(n) for n in self.of.spec.fields]))
