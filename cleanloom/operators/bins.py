"""Discretising numeric columns (B1, B2)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.operators.local import Groups
from cleanloom.operators.options import Option, run
from cleanloom.plans import stats as st
from cleanloom.plans.grouping import Grouping, grouping


def uniform_option(n: int) -> Option:
    """Equal-width bins between the smallest and the largest training value."""

    def apply(x: Column, name: str) -> Column:
        step = (F.col(f"{name}_hi") - F.col(f"{name}_lo")) / n
        raw = ((x - F.col(f"{name}_lo")) / (step + 1e-12)).cast("bigint")
        return F.when(raw.isNotNull(), F.least(F.lit(n - 1), F.greatest(F.lit(0), raw))).cast("int")

    def local(x: np.ndarray, g: Groups) -> np.ndarray:
        low = g.least(x)
        step = (g.largest(x) - low) / n
        return np.clip(np.trunc((x - low[g.owner]) / (step[g.owner] + 1e-12)), 0, n - 1)

    return Option(f"uniform_{n}", [lambda x, name: {f"{name}_lo": st.low(x), f"{name}_hi": st.high(x)}], apply, local=local)


def quantile_option(n: int) -> Option:
    """Bins cut at every ``round(N / n)``-th sorted training value; the bin is the number of cuts below the value."""

    def apply(x: Column, name: str) -> Column:
        below = F.coalesce(F.size(F.filter(F.col(f"{name}_cuts"), lambda cut: cut < x)), F.lit(0))
        return F.when(x.isNotNull(), F.least(F.lit(n - 1), below)).cast("int")

    def local(x: np.ndarray, g: Groups) -> np.ndarray:
        return np.where(np.isnan(x), np.nan, np.minimum(n - 1, g.below(x, n)))

    return Option(f"quantile_{n}", [lambda x, name: {f"{name}_cuts": st.cuts(x, n)}], apply, local=local)


def uniform_bins(
    df: DataFrame, keys: Sequence[str] | Grouping, columns: Sequence[str], n: int, is_train: Column | None = None
) -> DataFrame:
    """B1. Equal-width bins 0..n-1."""
    return run(df, grouping(df, keys), {c: (c, uniform_option(n)) for c in columns}, is_train)


def quantile_bins(
    df: DataFrame, keys: Sequence[str] | Grouping, columns: Sequence[str], n: int, is_train: Column | None = None
) -> DataFrame:
    """B2. Equally filled bins 0..n-1."""
    return run(df, grouping(df, keys), {c: (c, quantile_option(n)) for c in columns}, is_train)
