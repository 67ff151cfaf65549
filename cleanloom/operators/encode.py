"""Turning categories into numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.plans.grouping import Grouping
from cleanloom.plans.ordered import join_on

MAX_CATEGORIES = 1000


def label_encode(
    df: DataFrame, column: str, out: str, keys: Sequence[str] = (), max_rows: int | None = None
) -> DataFrame:
    """E1. Position of the value among the sorted distinct values (of its group), from 0. Missing stays missing."""
    values = df.where(F.col(column).isNotNull()).select(*keys, column).distinct()
    g = Grouping.of(values, keys, max_rows)
    codes = g.number(values, [column]).select(*keys, column, (F.col("_rn") - 1).alias(out))
    return join_on(df, codes, [*keys, column], "left")


def categories(df: DataFrame, columns: Sequence[str], limit: int = MAX_CATEGORIES) -> dict[str, list]:
    """Sorted distinct values per column. A column with more than ``limit`` of them is an error, not cut short."""
    out = {}
    for c in columns:
        found = [r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().limit(limit + 1).collect()]
        if len(found) > limit:
            raise ValueError(f"column {c!r} has more than {limit} categories; drop it or use label_encode")
        out[c] = sorted(found)
    return out


def one_hot(df: DataFrame, vocabulary: Mapping[str, Sequence], keep: bool = False) -> DataFrame:
    """E2. One 0/1 column ``<column>_<value>`` per category; unknown and missing values give all zeros."""
    dummies = {
        f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)) for c, vs in vocabulary.items() for v in vs
    }
    out = df.withColumns(dummies)
    return out if keep else out.drop(*vocabulary)


def dummies_over_splits(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """E3. One-hot with the categories of both splits, so both get the same columns."""
    vocabulary = categories(train.select(*columns).unionByName(test.select(*columns)), columns)
    return one_hot(train, vocabulary), one_hot(test, vocabulary)


def feature_block(
    df: DataFrame, numeric: Sequence[str], vocabulary: Mapping[str, Sequence], keep: Sequence[str | Column] = ()
) -> DataFrame:
    """E4. Numeric columns followed by the encoded ones, names kept."""
    encoded = one_hot(df, vocabulary, keep=True)
    names = [f"{c}_{v}" for c, vs in vocabulary.items() for v in vs]
    return encoded.select(*keep, *numeric, *[F.col(f"`{n}`") for n in names])


def feature_vector(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """E4 in the form MLlib models read."""
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep").transform(df)
