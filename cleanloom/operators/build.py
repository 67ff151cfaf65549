"""From a raw table to a modelling set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.columns import text_columns
from cleanloom.operators.cleanse import drop_unseen_columns, drop_wide_categories
from cleanloom.operators.encode import label_encode
from cleanloom.operators.partitions import three_way_split


def build_data(
    df: DataFrame,
    label: str,
    order_by: Sequence[str | Column],
    max_categories: int = 1000,
    val_share: float = 0.2,
    test_share: float = 0.2,
) -> DataFrame:
    """D9. Encode the label among all rows, drop wide text columns, split three ways, drop columns without a value in
    the training rows. ``label`` is replaced by its code; ``split`` is added. Rows without a label have no code."""
    coded = label_encode(df, label, "_code").withColumn(label, F.col("_code")).drop("_code")
    narrow = drop_wide_categories(coded, text_columns(coded, exclude=[label]), max_categories)
    split = three_way_split(narrow, [], order_by, val_share, test_share)
    features = [c for c in narrow.columns if c != label]
    return drop_unseen_columns(split, features, F.col("split") == "train")
