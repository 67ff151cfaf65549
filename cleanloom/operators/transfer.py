"""How well a cleaning choice carries over between partitions and between groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.columns import wall_micros
from cleanloom.operators.features import rank_within
from cleanloom.plans import stats as st
from cleanloom.plans.grouping import Grouping
from cleanloom.plans.ordered import join_on
from cleanloom.session import cut

# partitions of a series per join cell; one cell yields at most CELL * CELL pairs per model and method
CELL = 256
# fixed values: small constants of the ratio measures
RATIO_FLOOR = 1e-3
DIFF_EPS = 1e-4


def method_ranks(
    scores: DataFrame, keys: Sequence[str], value: str = "rmse", ties: str = "average", out: str = "rank"
) -> DataFrame:
    """X1. Rank of each method inside ``keys`` (series, partition, model). A missing score ranks last."""
    by_row = Grouping.bounded(keys)  # as many rows as there are methods
    filled = by_row.with_stats(scores, {"_worst": st.high(value)})
    filled = filled.withColumn("_score", F.coalesce(F.col(value), F.col("_worst") + 1))
    return rank_within(filled, by_row, "_score", ties, out).drop("_worst", "_score")


def partition_pairs(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    partition: str = "partition_id",
    max_distance: int | None = None,
) -> DataFrame:
    """X8. All pairs of partitions i < j of a series, with ``values`` of both sides as ``<name>_i`` and ``<name>_j``.

    Their number grows with the square of a series' length. ``max_distance`` asks for pairs with j - i up to it only;
    the work then grows with the length.
    The self-join runs over cells of CELL x CELL partitions, so a series with very many partitions is spread over
    many tasks instead of meeting in one.
    """
    # a few columns per partition: written once, so that the rows behind them are not read for each side again
    small = cut(df.select(*keys, partition, *values))
    largest = small.groupBy(*keys).agg(F.max(F.floor(F.col(partition) / CELL)).alias("_last"))
    near = None if max_distance is None else F.lit(max_distance)
    left = join_on(
        small.select(*keys, F.col(partition).alias("i"), *[F.col(v).alias(f"{v}_i") for v in values]), largest, keys
    )
    left = (
        left.withColumn("_ci", F.floor(F.col("i") / CELL))
        .withColumn("_cj", F.explode(F.sequence("_ci", F.col("_last") if near is None else F.least("_last", F.floor((F.col("i") + near) / CELL)))))
        .drop("_last")
    )
    zero = F.lit(0).cast("bigint")
    right = (
        small.select(*keys, F.col(partition).alias("j"), *[F.col(v).alias(f"{v}_j") for v in values])
        .withColumn("_cj", F.floor(F.col("j") / CELL))
        .withColumn("_ci", F.explode(F.sequence(zero if near is None else F.greatest(zero, F.floor((F.col("j") - near) / CELL)), F.col("_cj"))))
    )
    both = join_on(left, right, [*keys, "_ci", "_cj"], "inner").where(F.col("i") < F.col("j")).drop("_ci", "_cj")
    return both if near is None else both.where(F.col("j") - F.col("i") <= near)


def partition_midpoints(df: DataFrame, keys: Sequence[str], time: str, partition: str = "partition_id") -> DataFrame:
    """Middle of the time span of every partition, in microseconds, and its row count."""
    micros = wall_micros(df, time)
    low, high = F.min(micros), F.max(micros)
    return df.groupBy(*keys, partition).agg(
        (low + F.floor((high - low) / 2)).alias("mid"), F.count(F.lit(1)).alias("n_rows")
    )


def distance_in_days(mid_1: Column, mid_2: Column) -> Column:
    """X6. Whole days between two midpoints, rounded to tens with ties to even."""
    days = F.floor(F.abs(mid_2 - mid_1) / F.lit(86_400_000_000))
    return (F.bround(days / 10) * 10).cast("bigint")


def distance_in_rows(n_1: Column, i: Column, n_2: Column, j: Column) -> Column:
    """X7. Distance between middle row numbers, for partitions without dates."""
    return F.abs(F.floor(n_1 * (i + 1) / 2) - F.floor(n_2 * (j + 1) / 2)).cast("bigint")


def partition_distances(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """X6-X8. Distance in days and in rows for all partition pairs."""
    pairs = partition_pairs(partition_midpoints(df, keys, time), keys, ["mid", "n_rows"])
    return pairs.select(
        *keys,
        "i",
        "j",
        distance_in_days(F.col("mid_i"), F.col("mid_j")).alias("distance"),
        distance_in_rows(F.col("n_rows_i"), F.col("i"), F.col("n_rows_j"), F.col("j")).alias("row_distance"),
    )


def middle_row_time(df: DataFrame, keys: Sequence[str], time: str, row: str = "series_row") -> DataFrame:
    """X9. Time of the row at position ``n // 2`` of every partition, found from the position in the series."""
    spans = df.groupBy(*keys).agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("_n"))
    middle = spans.select(*keys, (F.col("_first") + F.floor(F.col("_n") / 2)).alias(row))
    return join_on(df, middle, [*keys, row], "left_semi").select(*keys, F.col(time).alias("midpoint"))


def attach_midpoint(scores: DataFrame, midpoints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """X10. The middle time of its partition on every score row."""
    return join_on(scores, midpoints, keys, "inner")


def unpivot_scores(wide: DataFrame, keys: Sequence[str], methods: Sequence[str], value: str = "MSE") -> DataFrame:
    """X5. Wide scores to long form."""
    return wide.unpivot(list(keys), list(methods), "metric", value)


# The pair measures take ``max_distance`` (see ``partition_pairs``) and ``carry``: columns of a partition, such as its
# midpoint, that every pair gets for both sides.


def _sides(carry: Sequence[str]) -> list[str]:
    return [f"{c}_{side}" for c in carry for side in "ij"]


def rank_difference(
    scores: DataFrame,
    series: Sequence[str],
    value: str = "rmse",
    ties: str = "min",
    max_distance: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """X2, X11. Absolute difference of a method's rank between all partition pairs of a series."""
    ranked = rank_within(scores, Grouping.bounded([*series, "partition_id", "model"]), value, ties)
    pairs = partition_pairs(ranked, [*series, "model", "method"], ["rank", *carry], max_distance=max_distance)
    difference = F.abs(F.col("rank_i") - F.col("rank_j")).alias("rank_difference")
    return pairs.select(*series, "model", "method", "i", "j", difference, *_sides(carry))


def performance_ratio(
    scores: DataFrame, series: Sequence[str], value: str = "rmse", max_distance: int | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """X3, X11. ``(later + m) / (earlier + m)`` for all partition pairs, where m is the smallest positive score in the
    two partitions (over all models and methods), at most 1e-3."""
    part = [*series, "partition_id"]
    smallest = scores.groupBy(*part).agg(F.min(F.when(F.col(value) > 0, F.col(value))).alias("_least"))
    kept = join_on(scores, smallest, part).select(*part, "model", "method", F.col(value).alias("score"), "_least", *carry)
    pairs = partition_pairs(kept, [*series, "model", "method"], ["score", "_least", *carry], max_distance=max_distance)
    m = F.least(F.lit(RATIO_FLOOR), F.col("_least_i"), F.col("_least_j"))
    ratio = F.try_divide(F.col("score_j") + m, F.col("score_i") + m).alias("performance_ratio")
    return pairs.select(*series, "model", "method", "i", "j", ratio, *_sides(carry))


def abs_difference_ratio(
    scores: DataFrame,
    series: Sequence[str],
    value: str = "rmse",
    base_method: str = "Noclean",
    max_distance: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """X4. Score change of a method relative to the change of the base method, for all partition pairs."""
    part = [*series, "partition_id", "model"]
    base = scores.where(F.col("method") == base_method).select(*part, F.col(value).alias("base"))
    kept = join_on(scores.select(*part, "method", F.col(value).alias("score"), *carry), base, part, "inner")
    pairs = partition_pairs(kept, [*series, "model", "method"], ["score", "base", *carry], max_distance=max_distance)
    eps = F.lit(DIFF_EPS)
    ratio = (F.abs(F.col("score_i") - F.col("score_j")) + eps) / (F.abs(F.col("base_i") - F.col("base_j")) + eps)
    return pairs.select(*series, "model", "method", "i", "j", ratio.alias("abs_diff_ratio"), *_sides(carry))


def mean_by_distance(pairs: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """X11 in short. Mean of a pair measure and number of pairs per ``keys`` and distance in days, from pairs that carry
    the midpoint ``mid``. Pairs are added up where they are made; they are neither written nor shuffled."""
    distance = distance_in_days(F.col("mid_i"), F.col("mid_j")).alias("distance")
    return pairs.groupBy(*keys, distance).agg(F.avg(measure).alias(measure), F.count(measure).alias("n_pairs"))


def with_distance(pairs: DataFrame, distances: DataFrame, series: Sequence[str]) -> DataFrame:
    """X11. Add the distance of the two partitions to pair measures."""
    return join_on(pairs, distances, [*series, "i", "j"], "inner")


# -- between groups -------------------------------------------------------------------------------------------------


def map_groups(scores: DataFrame, groups: DataFrame, order: str | None = None) -> DataFrame:
    """X12. Group names of source and target; rows without both are dropped.

    ``groups`` has the columns name and group. Of duplicate names the last row wins, by the column ``order``.
    """
    if order is not None:
        groups = groups.groupBy("name").agg(F.max_by("group", order).alias("group"))
    out = scores
    for side, name in (("group_i", "source"), ("group_j", "target")):
        renamed = groups.select(F.col("name").alias(f"_{side}"), F.col("group").alias(side))
        out = out.join(renamed, F.col(name) == F.col(f"_{side}"), "left").drop(f"_{side}")
    return out.dropna(subset=["group_i", "group_j"])


def group_matrix(mapped: DataFrame, value: str = "score") -> DataFrame:
    """X13, X14. Mean score per (target group, source group) in long form; each group has 1.0 with itself added once."""
    # one row per pair of groups, read three times below
    cells = cut(mapped.groupBy("group_j", "group_i").agg(F.sum(value).alias("_s"), F.count(value).alias("_n")))
    names = cells.select("group_i").union(cells.select("group_j")).distinct()
    own = names.select(
        F.col("group_i").alias("group_j"), F.col("group_i"), F.lit(1.0).alias("_s"), F.lit(1).cast("bigint").alias("_n")
    )
    merged = cells.unionByName(own).groupBy("group_j", "group_i").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    return merged.where(F.col("_n") > 0).select("group_j", "group_i", (F.col("_s") / F.col("_n")).alias("score"))


def group_index(matrix: DataFrame) -> DataFrame:
    """X15. 0-based position of every group among the sorted names."""
    names = matrix.select(F.col("group_i").alias("group")).union(matrix.select("group_j")).distinct()
    numbered = Grouping.of(names, []).number(names, ["group"])
    return numbered.select("group", (F.col("_rn") - 1).alias("index"))


def indexed_matrix(matrix: DataFrame) -> DataFrame:
    """X15. The matrix with group numbers instead of names."""
    matrix = cut(matrix)
    index = group_index(matrix)
    out = matrix
    for side in ("group_j", "group_i"):
        renamed = index.select(F.col("group").alias("_g"), F.col("index").alias(side.replace("group", "index")))
        out = out.join(renamed, F.col(side) == F.col("_g")).drop("_g")
    return out.select("index_j", "index_i", "score")


def wide_matrix(matrix: DataFrame, limit: int = 1000) -> DataFrame:
    """X14. Target groups as rows and source groups as columns, sorted. For at most ``limit`` source groups."""
    names = [r[0] for r in matrix.select("group_i").distinct().limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} groups; use the long form")
    return matrix.groupBy("group_j").pivot("group_i", sorted(names)).agg(F.first("score")).orderBy("group_j")
