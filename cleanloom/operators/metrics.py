"""Scores of predictions as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.operators.features import rank_within
from cleanloom.plans.ordered import join_on


def regression_metrics(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """MSE, RMSE, MAE and R2 per key."""
    error = F.col(actual) - F.col(predicted)
    mse = F.avg(error * error)
    return df.groupBy(*keys).agg(
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.try_divide(mse, F.var_pop(actual))).alias("r2"),
    )


def classification_metrics(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Accuracy and support-weighted F1 per key, from one confusion count."""
    cells = df.groupBy(*keys, actual, predicted).agg(F.count(F.lit(1)).alias("_n"))
    sides = F.array(
        F.struct(F.col(actual).alias("label"), F.col("_n").alias("support"), F.lit(0).cast("bigint").alias("guessed")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("_n").alias("guessed")),
    )
    hit = F.when(F.col(actual) == F.col(predicted), F.col("_n")).otherwise(0)
    # the hit count is carried by the actual side only
    per_label = (
        cells.select(*keys, hit.alias("_hit"), F.posexplode(sides).alias("_side", "_cell"))
        .select(*keys, "_cell.*", F.when(F.col("_side") == 0, F.col("_hit")).otherwise(0).alias("hit"))
        .groupBy(*keys, "label")
        .agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    )
    f1 = 2 * F.col("hit") / (F.col("support") + F.col("guessed"))
    return per_label.groupBy(*keys).agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


def roc_auc(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve per key by the rank sum of the positive rows, ties averaged."""
    ranked = rank_within(df.where(F.col(score).isNotNull()), keys, score, "average", "_rank")
    positive = F.sum(F.col(label).cast("bigint"))
    negative = F.sum(1 - F.col(label).cast("bigint"))
    ranks = F.sum(F.when(F.col(label) == 1, F.col("_rank")))
    return ranked.groupBy(*keys).agg(
        F.try_divide(ranks - positive * (positive + 1) / 2, (positive * negative).cast("double")).alias("auc")
    )


def score_text(c: Column) -> Column:
    """M15. A score with four decimals as text; tables keep DOUBLE."""
    return F.format_string("%.4f", F.round(c, 4))


def merge_metrics(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics of the same keys side by side."""
    return join_on(a, b, keys, "inner")
