"""Outlier detection and repair per column."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.operators.impute import fill_stat, stat_value
from cleanloom.operators.local import Groups
from cleanloom.operators.options import IDENTITY, Option, run
from cleanloom.plans import stats as st
from cleanloom.plans.grouping import Grouping, grouping
from cleanloom.plans.stats import Stat

CLEANERS = ("ZS_4", "ZS_3", "ZS_2", "MAD_3", "MAD_2.5", "MAD_2", "IQR_2", "IQR_1.5", "IQR_1", "identity")
# fixed values: the widths used when a rule is named without one
DEFAULT_WIDTHS = {"ZS": 3.0, "IQR": 1.5, "MAD": 2.5}
Z_LIMIT = 0.5


def repair_with_fences(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    columns: Sequence[str],
    repair: str,
    is_train: Column,
    width: float = 1.5,
) -> DataFrame:
    """O1. Cells outside ``[q1 - w iqr, q3 + w iqr]`` of the training rows get a training statistic.

    With mean and median the other splits are repaired with the statistic of the *already repaired* training column,
    as the training column is replaced first; the mode is taken once. Missing cells stay missing.
    """
    return grouping(df, keys).each(df, lambda rows, g: _fences(rows, g, columns, repair, is_train, width))


def _fences(df: DataFrame, g: Grouping, columns, repair: str, is_train: Column, width: float) -> DataFrame:
    out = g.with_stats(df, {f"_q_{c}": st.quantiles(c, [0.25, 0.75]).only(is_train) for c in columns})
    outside = {}
    for c in columns:
        q1, q3 = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        outside[c] = (F.col(c) < q1 - width * (q3 - q1)) | (F.col(c) > q3 + width * (q3 - q1))
    return _repair(g, out, columns, outside, repair, is_train, refit=True).drop(*[f"_q_{c}" for c in columns])


def repair_with_z_scores(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    columns: Sequence[str],
    repair: str,
    is_train: Column,
    limit: float = Z_LIMIT,
) -> DataFrame:
    """O3. Cells whose z score in their own split exceeds ``limit`` get a training statistic."""
    return grouping(df, keys).each(df, lambda rows, g: _z_scores(rows, g, columns, repair, is_train, limit))


def _z_scores(df: DataFrame, g: Grouping, columns, repair: str, is_train: Column, limit: float) -> DataFrame:
    specs = {}
    for c in columns:
        for side, rows in (("a", is_train), ("b", ~is_train)):
            specs[f"_m{side}_{c}"] = st.mean(c).only(rows)
            specs[f"_s{side}_{c}"] = st.std(c).only(rows)
    out = g.with_stats(df, specs)
    outside = {}
    for c in columns:
        mean = F.when(is_train, F.col(f"_ma_{c}")).otherwise(F.col(f"_mb_{c}"))
        spread = F.when(is_train, F.col(f"_sa_{c}")).otherwise(F.col(f"_sb_{c}"))
        outside[c] = F.abs(F.col(c) - mean) > limit * spread
    return _repair(g, out, columns, outside, repair, is_train, refit=False).drop(*specs)


def _repair(
    g: Grouping,
    df: DataFrame,
    columns: Sequence[str],
    outside: dict[str, Column],
    repair: str,
    is_train: Column,
    refit: bool,
) -> DataFrame:
    out = df.withColumns({f"_out_{c}": F.coalesce(outside[c], F.lit(False)) for c in columns})
    out = g.with_stats(out, {f"_fix_{c}": fill_stat(repair, c).only(is_train) for c in columns})
    fixed = {c: F.when(F.col(f"_out_{c}"), stat_value(repair, f"_fix_{c}")).otherwise(F.col(c)) for c in columns}
    helpers = [f"_out_{c}" for c in columns] + [f"_fix_{c}" for c in columns]
    if not refit or repair == "mode":
        return out.withColumns(fixed).drop(*helpers)
    out = out.withColumns({c: F.when(is_train, fixed[c]).otherwise(F.col(c)) for c in columns})
    out = g.with_stats(out, {f"_re_{c}": fill_stat(repair, c).only(is_train) for c in columns})
    again = {
        c: F.when(~is_train & F.col(f"_out_{c}"), stat_value(repair, f"_re_{c}")).otherwise(F.col(c)) for c in columns
    }
    return out.withColumns(again).drop(*helpers, *[f"_re_{c}" for c in columns])


def parse_rule(name: str) -> tuple[str, float]:
    """``"MAD_2.5"`` is the rule MAD with width 2.5."""
    rule, _, width = name.partition("_")
    if rule not in DEFAULT_WIDTHS:
        raise ValueError(f"unknown outlier rule {name!r}")
    return rule, float(width) if width else DEFAULT_WIDTHS[rule]


def cleaner_option(name: str) -> Option:
    """O4-O7. Cells outside the bounds of a rule get the mean of the training cells inside them.

    ZS_k: mean +- k population deviations. IQR_k: quartiles +- k inter-quartile ranges. MAD_k: median +- k median
    absolute deviations. A column without any cell inside the bounds is repaired with 0. ``identity`` changes nothing.
    """
    if name == "identity":
        return IDENTITY
    kind, k = parse_rule(name)

    def bounds(p: str) -> tuple[Column, Column]:
        a, b = F.col(f"{p}_a"), F.col(f"{p}_b")
        if kind == "ZS":
            return a - k * b, a + k * b
        if kind == "IQR":
            return a[0] - k * (a[1] - a[0]), a[1] + k * (a[1] - a[0])
        return a[0] - k * b[0], a[0] + k * b[0]

    def inside(x: Column, p: str) -> Column:
        low, high = bounds(p)
        return (x >= low) & (x <= high)

    def first(x: Column, p: str) -> dict[str, Stat]:
        if kind == "ZS":
            return {f"{p}_a": st.mean(x), f"{p}_b": st.std(x)}
        return {f"{p}_a": st.quantiles(x, [0.25, 0.75]) if kind == "IQR" else st.median(x)}

    def spread(x: Column, p: str) -> dict[str, Stat]:
        return {f"{p}_b": st.median(F.abs(x - F.col(f"{p}_a")[0]))}

    def repair(x: Column, p: str) -> dict[str, Stat]:
        return {f"{p}_in": st.mean(x).only(inside(x, p))}

    def apply(x: Column, p: str) -> Column:
        return F.when(x.isNull() | inside(x, p), x).otherwise(F.coalesce(F.col(f"{p}_in"), F.lit(0.0)))

    def local(x: np.ndarray, g: Groups) -> np.ndarray:
        if kind == "ZS":
            middle, width = g.mean(x), g.std(x)
            low, high = middle - k * width, middle + k * width
        elif kind == "IQR":
            a, b = g.quantiles(x, [0.25, 0.75])
            low, high = a - k * (b - a), b + k * (b - a)
        else:
            middle = g.quantiles(x, [0.5])[0]
            width = g.quantiles(np.abs(x - middle[g.owner]), [0.5])[0]
            low, high = middle - k * width, middle + k * width
        within = (x >= low[g.owner]) & (x <= high[g.owner])
        return np.where(np.isnan(x) | within, x, np.nan_to_num(g.mean(np.where(within, x, np.nan)))[g.owner])

    return Option(name, [first, spread, repair] if kind == "MAD" else [first, repair], apply, local=local)


def clean_outliers(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    columns: Sequence[str],
    rule: str,
    is_train: Column | None = None,
) -> DataFrame:
    """O4-O7 on ``columns``; see ``cleaner_option``."""
    return run(df, grouping(df, keys), {c: (c, cleaner_option(rule)) for c in columns}, is_train)
