"""Positions and running sums inside groups that may be too large for one task.

A window over a whole group sorts that group in one task. When a group is larger than ``max_rows`` its rows are
first dealt out by ranges of the keys and order columns. Part totals are small and give the offset of every part, so
the window runs inside parts only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.session import cut


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", small: bool = False) -> DataFrame:
    """Join on ``keys`` where NULL equals NULL. ``small`` may be set only where the row count has a proven bound."""
    renamed = right.select(
        [F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns]
    )
    if small:
        renamed = F.broadcast(renamed)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def split_in_order(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], max_rows: int) -> DataFrame:
    """Add ``_part`` (BIGINT), increasing along ``order_by`` inside each key, with about a third of ``max_rows`` rows per part.

    Spark's range partitions of the keys and order columns, written once so that each row keeps its part. Only
    rows that agree in all of these columns cannot be parted.
    """
    parts = max(1, -(-3 * df.count() // max_rows))
    dealt = df.repartitionByRange(parts, *keys, *order_by)
    return cut(dealt.withColumn("_part", F.spark_partition_id().cast("bigint")))


def running_total(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], max_rows: int, weight: str | None = None
) -> DataFrame:
    """Add ``_upto``, the sum of weights (default 1) up to and including the row, and ``_total`` of its group.

    For groups of any size. Rows that compare equal get running sums in an unspecified order, as with row_number.
    """
    w = F.col(weight) if weight else F.lit(1)
    parts = split_in_order(df, keys, order_by, max_rows)
    before = Window.partitionBy(*keys).orderBy("_part")
    offsets = (
        parts.groupBy(*keys, "_part")
        .agg(F.sum(w).alias("_sum"))
        .select(
            *keys,
            "_part",
            F.coalesce(F.sum("_sum").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
            F.sum("_sum").over(Window.partitionBy(*keys)).alias("_total"),
        )
    )
    inside = (
        Window.partitionBy(*keys, "_part").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        join_on(parts, offsets, [*keys, "_part"], "left")
        .withColumn("_upto", F.col("_before") + F.sum(w).over(inside))
        .drop("_part", "_before")
    )
