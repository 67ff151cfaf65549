"""Scaling numeric columns with statistics of the training rows (N-*)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.operators.local import Groups
from cleanloom.operators.options import Option, run
from cleanloom.plans import stats as st
from cleanloom.plans.grouping import Grouping, grouping
from cleanloom.plans.stats import Stat

# fixed value: scaled values are clipped to +-CLIP
CLIP = 1e10

SCALERS = ("ZS", "MM", "MA", "RS")


def scale_stats(kind: str, column: str | Column, name: str) -> dict[str, Stat]:
    """The statistics a scaler needs, under names starting with ``name``."""
    if kind == "ZS":
        return {f"{name}_a": st.mean(column), f"{name}_b": st.std(column)}
    if kind == "MM":
        return {f"{name}_a": st.low(column), f"{name}_b": st.high(column)}
    if kind == "MA":
        return {f"{name}_a": st.max_abs(column)}
    if kind == "RS":
        return {f"{name}_a": st.quantiles(column, [0.25, 0.5, 0.75])}
    raise ValueError(f"unknown scaler {kind!r}; use one of {SCALERS}")


def scaled(kind: str, x: Column, name: str, clip: bool = True) -> Column:
    """The scaled value. A spread of zero counts as one, missing stays missing."""
    a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
    if kind == "ZS":
        shift, spread = a, b
    elif kind == "MM":
        shift, spread = a, b - a
    elif kind == "MA":
        shift, spread = F.lit(0.0), a
    else:
        shift, spread = a[1], a[2] - a[0]
    out = (x - shift) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    if kind == "MM" and clip:
        out = _within(out, 0.0, 1.0)
    return _within(out, -CLIP, CLIP) if clip else out


def _within(x: Column, low: float, high: float) -> Column:
    # least and greatest skip NULL, so missing values need the guard
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def scaler_option(kind: str, clip: bool = True) -> Option:
    def local(x: np.ndarray, g: Groups) -> np.ndarray:
        if kind == "ZS":
            shift, spread = g.mean(x), g.std(x)
        elif kind == "MM":
            shift = g.least(x)
            spread = g.largest(x) - shift
        elif kind == "MA":
            shift, spread = np.zeros(g.count), g.largest(np.abs(x))
        else:
            low, shift, high = g.quantiles(x, [0.25, 0.5, 0.75])
            spread = high - low
        out = (x - shift[g.owner]) / np.where(spread == 0, 1.0, spread)[g.owner]
        if kind == "MM" and clip:
            out = np.clip(out, 0.0, 1.0)
        return np.clip(out, -CLIP, CLIP) if clip else out

    return Option(kind, [lambda x, name: scale_stats(kind, x, name)], lambda x, name: scaled(kind, x, name, clip), local=local)


def scale(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    columns: Sequence[str],
    kind: str = "ZS",
    is_train: Column | None = None,
    clip: bool = True,
) -> DataFrame:
    """Scale ``columns`` per group: ZS standard, MM min-max, MA max-abs, RS median and inter-quartile range.

    ``clip=False`` with MM is the plain min-max form that may leave [0, 1] outside the training rows (N-PRE).
    """
    return run(df, grouping(df, keys), {c: (c, scaler_option(kind, clip)) for c in columns}, is_train)
