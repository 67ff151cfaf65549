"""Column-level helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of the numeric columns, in schema order."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of the string columns, in schema order."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in set(exclude)]


def random_order(row_id: Iterable[str | Column], seed: int = 42, salt: str = "") -> Column:
    """A repeatable random order: a hash of stable row columns, so it survives repartitioning and retries."""
    return F.xxhash64(F.lit(seed), F.lit(salt), *[as_column(c) for c in row_id]).bitwiseAND(F.lit((1 << 52) - 1))


def floor_share(n: Column, share: float) -> Column:
    """``int(n * share)``, the truncating row count."""
    return (n * F.lit(share)).cast("bigint")


def half_even_share(n: Column, share: float) -> Column:
    """``round(n * share)`` with ties to even."""
    return F.bround(n * F.lit(share)).cast("bigint")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Make NULL the only missing marker: NaN in floating columns becomes NULL."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        [
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, floating) else F.col(f.name)
            for f in df.schema
        ]
    )


def any_null(columns: Iterable[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def wall_micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a date or timestamp, by the clock it shows for types without a time zone."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    days = F.unix_date(c.cast("date")).cast("bigint") * 86_400_000_000
    if isinstance(kind, T.DateType):
        return days
    seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.date_part(F.lit("SECOND"), c)
    return days + (seconds * 1_000_000).cast("bigint")
