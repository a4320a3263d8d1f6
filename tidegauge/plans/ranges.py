"""Time ranges, their split into aligned pieces, and the choice of a plan by cost. No Spark here."""

from __future__ import annotations

from dataclasses import dataclass

#: Seconds of a slot of each level, fine to coarse; weeks and years (of 52 weeks) count from the origin, the others from the epoch.
LEVELS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800, "year": 31_449_600}
#: Levels that pieces of a range can have.
ALIGNED = ("second", "minute", "hour", "day")
#: Combinations that all levels' totals take, and below which a plan on one level isn't worth bettering.
LANDMARK_COST, SMALL = 6, 60


@dataclass(frozen=True, order=True)
class TimeRange:
    """Whole seconds from start to before end."""

    start: int
    end: int

    @classmethod
    def of_millis(cls, start_ms: int, end_ms: int) -> TimeRange:
        if start_ms < 0:
            raise ValueError("start lies before the epoch")
        if end_ms < start_ms:
            raise ValueError("end lies before the start")
        return cls(start_ms // 1000, end_ms // 1000)

    @property
    def duration(self) -> int:
        return self.end - self.start

    @property
    def granularity(self) -> str:
        """The coarsest level to which both bounds are aligned."""
        return next(n for n in reversed(ALIGNED) if self.start % LEVELS[n] == 0 and self.end % LEVELS[n] == 0)

    @property
    def slots(self) -> int:
        return self.duration // LEVELS[self.granularity]

    def clipped(self, origin: int, watermark: int) -> TimeRange:
        return TimeRange(max(self.start, origin), min(self.end, watermark))


@dataclass(frozen=True)
class Piece:
    level: str
    start: int
    end: int

    @property
    def slots(self) -> int:
        return (self.end - self.start) // LEVELS[self.level]


def split(r: TimeRange) -> list[Piece]:
    """Pieces of r in time order, each aligned to its level: up to coarser levels as soon as the start allows, down again to the end."""
    out, at = [], r.start

    def go(level: str, to: int) -> None:
        nonlocal at
        if at < to:
            out.append(Piece(level, at, to))
            at = to

    for fine, coarse in zip(ALIGNED, ALIGNED[1:], strict=False):
        size = LEVELS[coarse]
        up = -(-at // size) * size
        if up + size > r.end and at % size:  # no whole coarse slot follows
            break
        go(fine, up)
    for level in reversed(ALIGNED):
        if at % LEVELS[level] == 0:
            go(level, r.end // LEVELS[level] * LEVELS[level])
    return out


@dataclass(frozen=True)
class Plan:
    """kind: landmark, single, combined, prefix, inverse, scan (of events) or empty. pieces are added; for inverse they are what the whole history has too much."""

    kind: str
    pieces: tuple[Piece, ...]
    cost: int


def choose(r: TimeRange, origin: int, watermark: int, *, prefix: bool = False, invertible: bool = False, use_inverse: bool = False, single_up_to: int = 0) -> Plan:
    """The cheapest plan for r, in combinations; single_up_to: slots up to which a plan on one level is taken whatever the others cost.

    The range is clipped to origin and watermark. prefix: levels carry running totals, so one level answers at cost 1.
    """
    c = r.clipped(origin, watermark)
    if c.start >= c.end:
        return Plan("empty", (), 0)
    if c.start == origin and c.end == watermark:
        return Plan("landmark", tuple(split(c)), LANDMARK_COST)
    one = Piece(c.granularity, c.start, c.end)
    single = Plan("prefix", (one,), 1) if prefix else Plan("single", (one,), one.slots)
    if prefix or single.cost < SMALL or single.cost <= single_up_to:
        return single
    pieces = tuple(split(c))
    plans = [single, Plan("combined", pieces, sum(p.slots for p in pieces) + len(pieces))]
    if invertible and use_inverse:
        outside = tuple(p for side in (TimeRange(origin, c.start), TimeRange(c.end, watermark)) if side.duration > 0 for p in split(side))
        plans.append(Plan("inverse", outside, LANDMARK_COST + sum(p.slots for p in outside) + 2))
    return min(plans, key=lambda p: p.cost)
