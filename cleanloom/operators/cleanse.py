"""Column and row cleaning that needs no model: money text, dates, sentinels, sparse columns, profiles."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.columns import any_null, numeric_columns, text_columns
from cleanloom.plans.grouping import Grouping, grouping
from cleanloom.plans.ordered import join_on


def money_text_to_double(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """P1. String columns in which any value contains ``$`` become DOUBLE; text that is no number becomes NULL."""
    candidates = list(columns or text_columns(df))
    if not candidates:
        return df
    # one row of flags decides the schema
    flags = df.agg(*[F.max(F.col(c).contains("$")).alias(c) for c in candidates]).first()
    return df.withColumns(
        {c: F.regexp_replace(c, "[$,]", "").try_cast("double") for c in candidates if flags[c]}
    )


def drop_text_after_first(df: DataFrame) -> DataFrame:
    """P2. Drop string columns, except the first column."""
    return df.drop(*[c for c in text_columns(df) if c != df.columns[0]])


def parse_month_first_date(df: DataFrame, column: str, strict: bool = True) -> DataFrame:
    """P3. Text such as ``1/31/2020`` becomes DATE. Bad text raises, or gives NULL when not strict."""
    parse = F.to_date if strict else F.try_to_date
    return df.withColumn(column, parse(F.col(column), "M/d/yyyy"))


def date_from_parts(df: DataFrame, year: str, month: str, day: str, out: str = "Date") -> DataFrame:
    """P4. Build a date from three integer columns, drop rows where there is no such day, drop the three columns."""
    zero = F.lit(0)
    made = F.try_make_timestamp(F.col(year), F.col(month), F.col(day), zero, zero, zero).cast("date")
    return df.withColumn(out, made).where(F.col(out).isNotNull()).drop(year, month, day)


def sentinel_to_null(df: DataFrame, rules: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """P5. Values that stand for "missing" become NULL, in every numeric column whose name matches a pattern."""
    rules = rules or {"AvgTemperature": [-99]}
    changed = {}
    for pattern, values in rules.items():
        for c in numeric_columns(df):
            if re.search(pattern, c):
                changed[c] = F.when(~F.col(c).isin(list(values)), F.col(c))
    return df.withColumns(changed)


def missing_flags(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """P6. Whether any of the columns has a missing value, per ``by`` group (for example per split)."""
    return df.groupBy(*by).agg(F.max(any_null(columns)).alias("has_missing"))


def skip_warmup(df: DataFrame, keys: Sequence[str] | Grouping, order_by: Sequence, n: int = 365) -> DataFrame:
    """P7. Drop the first ``n`` rows of every series."""
    g = grouping(df, keys)
    return g.number(df, order_by).where(F.col("_rn") > n).drop("_rn", "_n")


def drop_unseen_columns(df: DataFrame, columns: Sequence[str], is_train: Column) -> DataFrame:
    """P8. Drop columns without any value in the training rows, from all splits."""
    seen = df.agg(*[F.count(F.when(is_train, F.col(c))).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if seen[c] == 0])


def drop_wide_categories(
    df: DataFrame, columns: Sequence[str] | None = None, limit: int = 1000, approx: bool = False
) -> DataFrame:
    """P9. Drop string columns with more than ``limit`` distinct values."""
    columns = list(columns or text_columns(df))
    if not columns:
        return df
    distinct = F.approx_count_distinct if approx else F.count_distinct
    # one small aggregate per column: several exact distinct counts in one aggregate would copy every row per column
    wide = [c for c in columns if df.agg(distinct(F.col(c)).alias("n")).first()["n"] > limit]
    return df.drop(*wide)


def drop_sparse_columns(
    df: DataFrame, target: str, max_missing: float = 0.5, max_categories: int = 500
) -> DataFrame:
    """P10. Drop columns missing in more than ``max_missing`` of the rows, rows without target, wide string columns."""
    share = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    kept = df.drop(*[c for c in df.columns if c != target and share[c] is not None and share[c] > max_missing])
    kept = kept.dropna(subset=[target])
    return drop_wide_categories(kept, text_columns(kept, exclude=[target]), max_categories)


def drop_incomplete_columns(df: DataFrame) -> DataFrame:
    """P11. Drop every column with a missing value."""
    missing = df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if missing[c]])


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """P12. Percentage of missing values per column (and per key), in long form."""
    columns = list(columns or [c for c in df.columns if c not in keys])
    wide = df.groupBy(*keys).agg(*[(100 * F.avg(F.col(c).isNull().cast("double"))).alias(c) for c in columns])
    return wide.unpivot(list(keys), columns, "column", "missing_pct")


def pending_work(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """S6. Work items that have no result yet."""
    return join_on(work, done.select(*keys).distinct(), list(keys), "left_anti")
