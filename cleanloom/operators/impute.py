"""Filling missing cells from statistics of the training rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.columns import any_null
from cleanloom.operators.local import Groups, filled
from cleanloom.operators.options import Option, run
from cleanloom.plans import stats as st
from cleanloom.plans.grouping import Grouping, grouping
from cleanloom.plans.stats import Stat

# fixed values: the constants that stand for a missing category
MISSING_TEXT = "Missing"
DUMMY_CATEGORY = "dummy_category"

FILLS = {"mean": st.mean, "median": st.median, "mode": st.mode}
LOCAL_FILLS = {"mean": Groups.mean, "median": lambda g, x: g.quantiles(x, [0.5])[0], "mode": Groups.mode}


def fill_stat(method: str, column: str | Column) -> Stat:
    """The statistic behind a simple imputer."""
    return FILLS[method](column)


def stat_value(method: str, name: str) -> Column:
    """The single value of a fitted ``fill_stat`` column."""
    return F.col(name)[0] if method == "median" else F.col(name)


def imputer_option(method: str) -> Option:
    """Fill with a training statistic."""
    if method not in FILLS:
        raise ValueError(f"unknown imputer {method!r}; use one of {sorted(FILLS)}")
    return Option(
        method,
        [lambda x, name: {f"{name}_fill": fill_stat(method, x)}],
        lambda x, name: F.coalesce(x, stat_value(method, f"{name}_fill")),
        local=filled(LOCAL_FILLS[method]),
    )


def impute(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    columns: Sequence[str],
    method: str,
    is_train: Column | None = None,
) -> DataFrame:
    """I1-I3, I10. Fill missing cells with the mean, median or mode of the training rows of the same group.

    ``mode`` also fills string columns, and numeric and string columns together (I12).
    """
    return run(df, grouping(df, keys), {c: (c, imputer_option(method)) for c in columns}, is_train)


def impute_constant(df: DataFrame, columns: Sequence[str], value: str = MISSING_TEXT) -> DataFrame:
    """I11. Fill missing categories with a constant."""
    return df.fillna({c: value for c in columns})


def impute_stats(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    columns: Sequence[str],
    methods: Sequence[str] = ("mean", "median", "mode"),
    is_train: Column | None = None,
) -> DataFrame:
    """I14. The fitted values in long form: keys, method, column, value."""
    g = grouping(df, keys)
    train = F.lit(True) if is_train is None else is_train
    pairs = [(m, c) for m in methods for c in columns]
    wide = g.stats(df, {f"{m}|{c}": fill_stat(m, c).only(train) for m, c in pairs})
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("method"), F.lit(c).alias("column"), stat_value(m, f"`{m}|{c}`").alias("value"))
            for m, c in pairs
        ]
    )
    return wide.select(*g.keys, F.inline(cells))


def no_clean(
    df: DataFrame, keys: Sequence[str] | Grouping, columns: Sequence[str], is_train: Column
) -> DataFrame:
    """I8. No cleaning: training rows with a missing cell are dropped; other rows are filled with training means.

    Columns are handled in order, so the mean of a column is taken over the training rows that are complete in that
    column and in all columns before it.
    """
    g = grouping(df, keys)
    out = g.with_stats(df, sequential_means(columns, is_train))
    filled = {c: F.coalesce(F.col(c), F.col(f"_seq_{c}")) for c in columns}
    kept = out.where(~is_train | ~any_null(columns))
    return kept.withColumns(filled).drop(*[f"_seq_{c}" for c in columns])


def sequential_means(columns: Sequence[str], is_train: Column) -> dict[str, Stat]:
    """Mean of each column over training rows complete in this and all earlier columns, named ``_seq_<column>``."""
    out = {}
    for i, c in enumerate(columns):
        complete = reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in columns[: i + 1]], is_train)
        out[f"_seq_{c}"] = st.mean(c).only(complete)
    return out


def drop_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """I9. Drop rows with a missing cell in ``columns``; those columns become FLOAT."""
    return df.dropna(subset=list(columns)).withColumns({c: F.col(c).cast("float") for c in columns})
