"""Row-count partitions of series, and deterministic splits of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.columns import floor_share, half_even_share
from cleanloom.plans.grouping import Grouping, grouping
from cleanloom.plans.ordered import join_on


def _explode_partitions(numbered: DataFrame, width: Column, step: Column, keep_short: bool) -> DataFrame:
    """Copy every row into the partitions that cover its 0-based position ``_rn - 1``."""
    at = F.col("_rn") - 1
    first = F.greatest(F.lit(0), F.ceil((at - width + 1) / step)).cast("bigint")
    last = F.floor(at / step).cast("bigint")
    if not keep_short:
        last = F.least(last, F.floor((F.col("_n") - width) / step).cast("bigint"))
    # the guard keeps sequence() from counting down for rows that no partition covers
    covering = F.when(first <= last, F.sequence(first, F.greatest(first, last)))
    return numbered.withColumn("partition_id", F.explode(covering))


def row_partitions(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    order_by: Sequence[str | Column],
    width: int = 1400,
    step: int = 200,
    keep_short: bool = False,
) -> DataFrame:
    """D1, D2. Overlapping partitions of ``width`` consecutive rows starting every ``step`` rows.

    Adds ``partition_id`` and ``series_row`` (0-based). ``keep_short`` also keeps the shorter windows at the end.
    """
    numbered = grouping(df, keys).number(df, order_by)
    out = _explode_partitions(numbered, F.lit(width), F.lit(step), keep_short)
    return out.withColumn("series_row", F.col("_rn") - 1).drop("_rn", "_n")


def sized_partitions(
    df: DataFrame, keys: Sequence[str] | Grouping, order_by: Sequence[str | Column], parts: int
) -> DataFrame:
    """D3. Partitions of half the series each, spread so that about ``parts`` of them cover it."""
    if parts < 2:
        raise ValueError("parts must be at least 2")
    numbered = grouping(df, keys).number(df, order_by)
    width = F.floor(F.col("_n") / 2)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / (2 * (parts - 1))))
    out = _explode_partitions(numbered.where(F.col("_n") > 1), width, step, keep_short=False)
    return out.withColumn("series_row", F.col("_rn") - 1).drop("_rn", "_n")


def whole_series(df: DataFrame) -> DataFrame:
    """D4. The unpartitioned run: one partition per series."""
    return df.withColumn("partition_id", F.lit(0).cast("bigint"))


def hold_out(
    df: DataFrame, keys: Sequence[str] | Grouping, order_by: Sequence[str | Column], share: float = 0.2
) -> DataFrame:
    """D5. ``split`` is 'test' for the first ``round(share * n)`` rows of the given random order, else 'train'."""
    out = grouping(df, keys).number(df, order_by)
    test = F.col("_rn") <= half_even_share(F.col("_n"), share)
    return out.withColumn("split", F.when(test, "test").otherwise("train")).drop("_rn", "_n")


def three_way_split(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    order_by: Sequence[str | Column],
    val_share: float = 0.2,
    test_share: float = 0.2,
) -> DataFrame:
    """D6. ``int(share * n)`` rows each for test and validation, the rest for training."""
    out = grouping(df, keys).number(df, order_by)
    n_test, n_val = floor_share(F.col("_n"), test_share), floor_share(F.col("_n"), val_share)
    split = (
        F.when(F.col("_rn") <= n_test, "test").when(F.col("_rn") <= n_test + n_val, "val").otherwise("train")
    )
    return out.withColumn("split", split).drop("_rn", "_n")


def subsample(
    df: DataFrame, keys: Sequence[str] | Grouping, order_by: Sequence[str | Column], share: float
) -> DataFrame:
    """D7. Keep ``round(share * n)`` rows of every group."""
    out = grouping(df, keys).number(df, order_by)
    return out.where(F.col("_rn") <= half_even_share(F.col("_n"), share)).drop("_rn", "_n")


def fold_number(position: Column, n: Column, folds: int = 5) -> Column:
    """The contiguous fold of a 0-based position among n rows; the first ``n % folds`` folds are one row longer."""
    short, longer = F.floor(n / folds), n % folds
    inside = F.floor(position / (short + 1))
    # short is 0 only where every row lies in the longer folds
    rest = longer + F.floor((position - longer * (short + 1)) / F.greatest(short, F.lit(1)))
    return F.when(position < longer * (short + 1), inside).otherwise(rest).cast("int")


def k_fold(
    df: DataFrame, keys: Sequence[str] | Grouping, order_by: Sequence[str | Column], folds: int = 5
) -> DataFrame:
    """D8. Contiguous folds in row order."""
    out = grouping(df, keys).number(df, order_by)
    return out.withColumn("fold", fold_number(F.col("_rn") - 1, F.col("_n"), folds)).drop("_rn", "_n")


def random_batch(
    df: DataFrame, keys: Sequence[str] | Grouping, order_by: Sequence[str | Column], size: int
) -> DataFrame:
    """D10. At most ``size`` rows of every group in random order."""
    return grouping(df, keys).number(df, order_by).where(F.col("_rn") <= size).drop("_rn", "_n")


def sample_series(df: DataFrame, key: str, order: Column, k: int) -> DataFrame:
    """S7. All rows of k randomly chosen series. ``order`` is the random order of the key values."""
    chosen = df.select(key).distinct().orderBy(order, key).limit(k)
    return join_on(df, chosen, [key], "left_semi")
