"""Lagged rolling features, horizons and ranks of ordered series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from cleanloom.plans.grouping import Grouping, grouping

MEAN_WINDOWS = {"day_5": 5, "day_30": 30, "day_365": 365}
STD_WINDOWS = {"std_5": 5, "std_365": 365}


def rolling_features(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    order_by: Sequence[str | Column],
    column: str,
    means: Mapping[str, int] | None = None,
    stds: Mapping[str, int] | None = None,
) -> DataFrame:
    """W1, W2. Mean and sample deviation of the k rows before the current one; NULL unless all k have a value."""
    means = MEAN_WINDOWS if means is None else means
    stds = STD_WINDOWS if stds is None else stds

    sizes = sorted({*means.values(), *stds.values()})

    def build(rows: DataFrame, ordered: WindowSpec) -> DataFrame:
        parts = {k: _Part(k, i) for i, k in enumerate(sizes)}
        out = rows
        for p in parts.values():
            out = p.add_blocks(out, column, ordered)
        for p in parts.values():
            out = p.add_moments(out, ordered)
        full = {n: parts[k].mean for n, k in means.items()}
        full.update({n: F.sqrt(F.try_divide(parts[k].m2, F.lit(k - 1.0))) for n, k in stds.items()})
        size = {**means, **stds}
        out = out.withColumns({n: F.when(parts[size[n]].count == size[n], c) for n, c in full.items()})
        return out.drop(*[c for p in parts.values() for c in p.helpers])

    return grouping(df, keys).over_rows(df, order_by, max(sizes), 0, build)


# windows up to this many rows are aggregated directly
DIRECT_ROWS = 40


class _Part:
    """Count, mean and sum of squared deviations of the k rows before the current one.

    A sliding frame is aggregated anew for every row, so a frame of k rows costs k steps. Longer frames are put
    together from b frames of a rows (a * b close to k, a close to b) read at lags of a, and one rest frame: about
    2 * sqrt(k) steps. Deviations are merged about the common mean, never as differences of large sums.
    """

    def __init__(self, k: int, number: int):
        self.k, self.name = k, f"_w{number}"
        self.a = k if k <= DIRECT_ROWS else max(2, int(k**0.5))
        self.b, self.rest = divmod(k, self.a)
        self.helpers: list[str] = []
        self.count, self.mean, self.m2 = (F.col(f"{self.name}_{n}") for n in ("n", "mean", "m2"))

    def _frame(self, name: str, column: str, ordered: WindowSpec, first: int, last: int) -> dict[str, Column]:
        frame = ordered.rowsBetween(first, last)
        out = {
            f"{name}n": F.count(column).over(frame),
            f"{name}m": F.avg(column).over(frame),
            f"{name}v": F.var_pop(column).over(frame),
        }
        self.helpers += list(out)
        return out

    def add_blocks(self, df: DataFrame, column: str, ordered: WindowSpec) -> DataFrame:
        frames = self._frame(f"{self.name}a", column, ordered, -self.a, -1)
        if self.rest:
            frames.update(self._frame(f"{self.name}r", column, ordered, -self.k, -self.a * self.b - 1))
        return df.select("*", *[c.alias(n) for n, c in frames.items()])

    def add_moments(self, df: DataFrame, ordered: WindowSpec) -> DataFrame:
        blocks = []
        lagged = {}
        for i in range(self.b):
            names = [f"{self.name}a{x}" + (f"_{i}" if i else "") for x in "nmv"]
            blocks.append(names)
            if i:
                lagged.update({n: F.lag(f"{self.name}a{x}", self.a * i).over(ordered) for n, x in zip(names, "nmv")})
        if self.rest:
            blocks.append([f"{self.name}r{x}" for x in "nmv"])
        self.helpers += [*lagged, f"{self.name}_n", f"{self.name}_mean", f"{self.name}_m2"]
        out = df.select("*", *[c.alias(n) for n, c in lagged.items()])
        sizes = [self.a] * self.b + ([self.rest] if self.rest else [])
        counted = sum((F.coalesce(F.col(n), F.lit(0)) for n, _, _ in blocks), F.lit(0))
        # only used where every row of the frame has a value, so block sizes are the counts
        mean = sum((F.col(m) * size for (_, m, _), size in zip(blocks, sizes)), F.lit(0.0)) / self.k
        out = out.withColumn(f"{self.name}_n", counted).withColumn(f"{self.name}_mean", mean)
        deviations = sum(
            (
                (F.col(v) + (F.col(m) - self.mean) * (F.col(m) - self.mean)) * size
                for (_, m, v), size in zip(blocks, sizes)
            ),
            F.lit(0.0),
        )
        return out.withColumn(f"{self.name}_m2", deviations)


def lead_horizon(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    order_by: Sequence[str | Column],
    columns: Sequence[str],
    n: int,
    drop_incomplete: bool = True,
) -> DataFrame:
    """W3. The next n values of each column beside the current row; rows with any missing cell are dropped."""

    def build(rows: DataFrame, ordered: WindowSpec) -> DataFrame:
        ahead = [F.lead(c, i).over(ordered).alias(f"{c}_shifted_{i}") for c in columns for i in range(1, n + 1)]
        return rows.select("*", *ahead)

    out = grouping(df, keys).over_rows(df, order_by, 0, n, build)
    return out.dropna() if drop_incomplete else out


def rank_within(
    df: DataFrame, keys: Sequence[str] | Grouping, value: str, ties: str = "average", out: str = "rank"
) -> DataFrame:
    """W4, W5. Ascending rank inside each group; ties share their average or their smallest rank."""
    return grouping(df, keys).rank(df, value, ties, out)
