"""Aggregates: a partial of named fields, each lifted from an input and combined by a built-in aggregate function."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """lift: an input's part; combine: an aggregate function over parts, associative and commutative; identity: an empty slot's part, None for null; inverse: whether parts can be subtracted."""

    lift: Callable[[Column], Column]
    combine: Callable[[Column], Column]
    identity: object = None
    inverse: bool = False


@dataclass(frozen=True)
class Aggregate:
    """A partial is one column for each field, so that combining is partial aggregation in generated code, and scans read only the fields that are asked for.

    lower: the final value from the fields' columns.
    """

    name: str
    fields: Mapping[str, Field]
    lower: Callable[[Mapping[str, Column]], Column] = field(repr=False)

    @property
    def invertible(self) -> bool:
        return all(f.inverse for f in self.fields.values())

    def lifted(self, value: Column) -> list[Column]:
        """The aggregates over raw inputs."""
        return [f.combine(f.lift(value)).alias(n) for n, f in self.fields.items()]

    def combined(self) -> list[Column]:
        """The aggregates over partials."""
        return [f.combine(F.col(n)).alias(n) for n, f in self.fields.items()]

    def columns(self) -> dict[str, Column]:
        return {n: F.col(n) for n in self.fields}

    def filled(self) -> list[Column]:
        """The fields, with the identity where a slot is empty."""
        return [(F.coalesce(F.col(n), F.lit(f.identity)) if f.identity is not None else F.col(n)).alias(n) for n, f in self.fields.items()]

    def lowered(self) -> Column:
        return self.lower(self.columns())


def _same(v: Column) -> Column:
    return v


def _one(v: Column) -> Column:
    return F.when(v.isNotNull(), F.lit(1).cast("long"))


def _number(v: Column) -> Column:
    """NaN takes no part in a minimum or maximum."""
    return F.nanvl(v.cast("double"), F.lit(None).cast("double"))


_sum, _count = Field(_same, F.sum, 0, True), Field(_one, F.sum, 0, True)
_min, _max = Field(_same, F.min), Field(_same, F.max)

SUM = Aggregate("sum", {"sum": _sum}, lambda p: p["sum"])
COUNT = Aggregate("count", {"count": _count}, lambda p: p["count"])
MIN = Aggregate("min", {"min": _min}, lambda p: p["min"])
MAX = Aggregate("max", {"max": _max}, lambda p: p["max"])
MINMAX = Aggregate("minmax", {"min": _min, "max": _max}, lambda p: F.struct(p["min"].alias("min"), p["max"].alias("max")))
AVG = Aggregate("avg", {"sum": _sum, "count": _count}, lambda p: F.try_divide(p["sum"], p["count"]))
#: The average of whole numbers as a whole number, toward zero.
AVG_INT = Aggregate("avg_int", {"sum": _sum, "count": _count}, lambda p: F.when(p["count"] > 0, F.floor(F.abs(p["sum"]) / p["count"]) * F.signum(p["sum"])).cast("long"))
ALL = Aggregate("all", {"min": _min, "max": _max, "count": _count, "sum": _sum}, lambda p: F.struct(*[p[k].alias(k) for k in ("min", "max", "count", "sum")], F.try_divide(p["sum"], p["count"]).alias("avg")))
MIN_FLOAT = Aggregate("min_float", {"min": Field(_number, F.min)}, lambda p: p["min"])
MAX_FLOAT = Aggregate("max_float", {"max": Field(_number, F.max)}, lambda p: p["max"])
#: Exact distinct values; the partial is a sorted set.
DISTINCT = Aggregate("distinct", {"set": Field(lambda v: F.array(v), lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))))}, lambda p: p["set"])


def of_attributes(**parts: tuple[str, Aggregate]) -> Aggregate:
    """An aggregate of a struct input: name=(attribute, aggregate) for each part; lowers to a struct of the parts."""
    fields, lows = {}, {}
    for name, (attribute, inner) in parts.items():
        for n, f in inner.fields.items():
            fields[f"{name}_{n}"] = Field(lambda v, f=f, a=attribute: f.lift(v[a]), f.combine, f.identity, f.inverse)
        lows[name] = lambda p, name=name, inner=inner: inner.lower({n: p[f"{name}_{n}"] for n in inner.fields}).alias(name)
    return Aggregate("_".join(parts), fields, lambda p: F.struct(*[low(p) for low in lows.values()]))
