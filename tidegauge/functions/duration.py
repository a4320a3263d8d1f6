"""Durations: whole nanoseconds, signed, with checked and saturating arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

NANO = 1_000_000_000
#: Seconds in each unit.
SECONDS = {"week": 604_800, "day": 86_400, "hour": 3600, "minute": 60, "second": 1}
_MOST = (2**63 - 1) * NANO + NANO - 1
_LEAST = -(2**63) * NANO - (NANO - 1)


@dataclass(frozen=True, order=True)
class Duration:
    """Between -(2^63) and 2^63 - 1 whole seconds and a fraction; what lies beyond raises OverflowError."""

    nanos: int

    def __post_init__(self) -> None:
        if not _LEAST <= self.nanos <= _MOST:
            raise OverflowError("duration out of range")

    @classmethod
    def of(cls, seconds: float = 0, nanoseconds: int = 0) -> Duration:
        whole = seconds * NANO if isinstance(seconds, int) else round(seconds * NANO)
        return cls(whole + nanoseconds)

    @property
    def is_zero(self) -> bool:
        return self.nanos == 0

    @property
    def is_negative(self) -> bool:
        return self.nanos < 0

    @property
    def is_positive(self) -> bool:
        return self.nanos > 0

    def __abs__(self) -> Duration:
        return self.saturated(abs(self.nanos))

    def __neg__(self) -> Duration:
        return Duration(-self.nanos)

    def __add__(self, other: Duration) -> Duration:
        return Duration(self.nanos + other.nanos)

    def __sub__(self, other: Duration) -> Duration:
        return Duration(self.nanos - other.nanos)

    def __mul__(self, k: int) -> Duration:
        return Duration(self.nanos * k)

    def __floordiv__(self, k: int) -> Duration:
        """Division toward zero."""
        return Duration(_toward_zero(self.nanos, k))

    @classmethod
    def saturated(cls, nanos: int) -> Duration:
        return cls(max(_LEAST, min(_MOST, nanos)))

    def checked_add(self, other: Duration) -> Duration | None:
        return self._checked(self.nanos + other.nanos)

    def checked_sub(self, other: Duration) -> Duration | None:
        return self._checked(self.nanos - other.nanos)

    def checked_mul(self, k: int) -> Duration | None:
        return self._checked(self.nanos * k)

    def checked_div(self, k: int) -> Duration | None:
        return None if k == 0 else self._checked(_toward_zero(self.nanos, k))

    def saturating_add(self, other: Duration) -> Duration:
        return self.saturated(self.nanos + other.nanos)

    def saturating_sub(self, other: Duration) -> Duration:
        return self.saturated(self.nanos - other.nanos)

    def saturating_mul(self, k: int) -> Duration:
        return self.saturated(self.nanos * k)

    @staticmethod
    def _checked(nanos: int) -> Duration | None:
        return Duration(nanos) if _LEAST <= nanos <= _MOST else None

    def whole(self, unit: str) -> int:
        """Whole units, toward zero: week, day, hour, minute, second, millisecond, microsecond, nanosecond."""
        return _toward_zero(self.nanos, SECONDS[unit] * NANO if unit in SECONDS else {"millisecond": 10**6, "microsecond": 10**3, "nanosecond": 1}[unit])

    def subsec(self, unit: str) -> int:
        """What whole seconds leave, in milliseconds, microseconds or nanoseconds."""
        return Duration(self.nanos - self.whole("second") * NANO).whole(unit)

    @property
    def seconds(self) -> float:
        return self.nanos / NANO

    def __str__(self) -> str:
        """`1d2h3m4.5s`, without units that are zero."""
        rest, out = abs(self.nanos), ""
        for unit, sign in (("day", "d"), ("hour", "h"), ("minute", "m")):
            n, rest = divmod(rest, SECONDS[unit] * NANO)
            out += f"{n}{sign}" if n else ""
        if rest or not out:
            s, frac = divmod(rest, NANO)
            out += f"{s}" + (f".{frac:09d}".rstrip("0") if frac else "") + "s"
        return ("-" if self.nanos < 0 else "") + out


def _toward_zero(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


ZERO, MIN, MAX = Duration(0), Duration(_LEAST), Duration(_MOST)
NANOSECOND, MICROSECOND, MILLISECOND, SECOND, MINUTE, HOUR, DAY, WEEK = (Duration(n) for n in (1, 10**3, 10**6, NANO, 60 * NANO, 3600 * NANO, 86_400 * NANO, 604_800 * NANO))


def weeks(n: float) -> Duration:
    return Duration.of(n * 604_800)


def days(n: float) -> Duration:
    return Duration.of(n * 86_400)


def hours(n: float) -> Duration:
    return Duration.of(n * 3600)


def minutes(n: float) -> Duration:
    return Duration.of(n * 60)


def seconds(n: float) -> Duration:
    return Duration.of(n)


def milliseconds(n: int) -> Duration:
    return Duration(n * 10**6)


def microseconds(n: int) -> Duration:
    return Duration(n * 10**3)


def nanoseconds(n: int) -> Duration:
    return Duration(n)


def years(n: float) -> Duration:
    """Years of 52 weeks, as the year level has them."""
    return weeks(52 * n)
