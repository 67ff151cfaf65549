"""Declared column statistics: what to compute, separate from how a group of a given size computes it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from cleanloom.functions.columns import as_column


@dataclass(frozen=True)
class Stat:
    kind: str
    column: Column
    shares: tuple[float, ...] = ()
    bins: int = 0

    def only(self, condition: Column) -> Stat:
        """The same statistic over the rows where ``condition`` holds."""
        return replace(self, column=F.when(condition, self.column))

    @property
    def needs_sorted_values(self) -> bool:
        """True when Spark's own aggregate would keep every distinct value of a group in one buffer."""
        return self.kind in ("quantiles", "mode", "cuts")

    def aggregate(self) -> Column:
        c = self.column
        if self.kind == "mean":
            return F.avg(c)
        if self.kind == "std":
            return F.stddev_pop(c)
        if self.kind == "min":
            return F.min(c)
        if self.kind == "max":
            return F.max(c)
        if self.kind == "max_abs":
            return F.max(F.abs(c))
        if self.kind == "count":
            return F.count(c)
        if self.kind == "sum":
            return F.sum(c)
        if self.kind == "quantiles":
            return F.percentile(c, list(self.shares))
        if self.kind == "mode":
            return F.mode(c, True)
        if self.kind == "cuts":
            return F.array_sort(F.collect_list(c))
        raise ValueError(f"unknown statistic {self.kind!r}")

    def finish(self, value: Column) -> Column:
        """What to keep of the aggregate."""
        if self.kind != "cuts":
            return value
        n, step = F.size(value), cut_step(F.size(value), self.bins)
        return F.filter(value, lambda _, i: ((i + 1) % step == 0) & (i + 1 < n))


def cut_step(n: Column, bins: int) -> Column:
    """Distance of the cut points of ``bins`` equally filled bins among n sorted values, at least 1."""
    return F.greatest(F.lit(1), F.bround(n / bins).cast("bigint"))


def mean(c: str | Column) -> Stat:
    return Stat("mean", as_column(c))


def std(c: str | Column) -> Stat:
    """Population standard deviation."""
    return Stat("std", as_column(c))


def low(c: str | Column) -> Stat:
    return Stat("min", as_column(c))


def high(c: str | Column) -> Stat:
    return Stat("max", as_column(c))


def max_abs(c: str | Column) -> Stat:
    return Stat("max_abs", as_column(c))


def count(c: str | Column) -> Stat:
    return Stat("count", as_column(c))


def total(c: str | Column) -> Stat:
    return Stat("sum", as_column(c))


def quantiles(c: str | Column, shares: Sequence[float]) -> Stat:
    """Exact linearly interpolated quantiles, as an array in the order of ``shares``."""
    return Stat("quantiles", as_column(c).cast("double"), tuple(shares))


def median(c: str | Column) -> Stat:
    return quantiles(c, [0.5])


def mode(c: str | Column) -> Stat:
    """Most frequent value, the smallest one on ties."""
    return Stat("mode", as_column(c))


def cuts(c: str | Column, bins: int) -> Stat:
    """Every ``round(n / bins)``-th sorted value except the last one: at most 2 * bins of them."""
    return Stat("cuts", as_column(c), bins=bins)
