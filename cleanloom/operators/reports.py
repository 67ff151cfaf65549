"""Summaries over many runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.plans import stats as st
from cleanloom.plans.grouping import Grouping


def option_counts(choices: DataFrame, columns: Sequence[str] = ("num_tf", "normalization")) -> DataFrame:
    """T1. How often each option was chosen, per kind of step."""
    cells = F.array(*[F.struct(F.lit(c).alias("step"), F.col(c).alias("options")) for c in columns])
    long = choices.select(F.inline(cells)).select("step", F.explode("options").alias("option"))
    return long.groupBy("step", "option").agg(F.count(F.lit(1)).alias("uses"))


def _zipped(choices: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs per feature, only for runs in which both lists are filled and equally long."""
    usable = (F.size(left) > 0) & (F.size(left) == F.size(right))
    return choices.where(usable).select(F.arrays_zip(F.col(left).alias("imputer"), F.col(right).alias("scaler")).alias("pairs"))


def option_chains(choices: DataFrame, left: str = "num_tf", right: str = "normalization") -> DataFrame:
    """T2. Number of runs per distinct full choice, as JSON text."""
    chain = F.to_json("pairs").alias("chain")
    return _zipped(choices, left, right).select(chain).groupBy("chain").agg(F.count(F.lit(1)).alias("runs"))


def top_chains(choices: DataFrame, n: int = 5, left: str = "num_tf", right: str = "normalization") -> DataFrame:
    """T2. The n most frequent full choices, ties in text order."""
    return option_chains(choices, left, right).orderBy(F.desc("runs"), "chain").limit(n)


def top_pairs(choices: DataFrame, n: int = 5, left: str = "num_tf", right: str = "normalization") -> DataFrame:
    """T3. The n most frequent (imputer, scaler) pairs of single features."""
    pairs = _zipped(choices, left, right).select(F.inline("pairs"))
    counted = pairs.groupBy("imputer", "scaler").agg(F.count(F.lit(1)).alias("uses"))
    return counted.orderBy(F.desc("uses"), "imputer", "scaler").limit(n)


def best_of(runs: DataFrame, keys: Sequence[str], loss: str, columns: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """T4. The row with the smallest loss per key; ``tie`` columns decide between equal losses."""
    best = F.min_by(F.struct(*columns), F.struct(loss, *tie))
    return runs.where(F.col(loss).isNotNull()).groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def result_summary(results: DataFrame, by: Sequence[str], losses: Sequence[str]) -> DataFrame:
    """T5. Count, minimum, median, mean and maximum of losses per collection of runs, in long form."""
    long = results.select(*by, *losses).unpivot(list(by), list(losses), "loss", "value")
    specs = {
        "runs": st.count("value"),
        "min": st.low("value"),
        "median": st.median("value"),
        "mean": st.mean("value"),
        "max": st.high("value"),
    }
    # one collection may hold most runs, so the exact median must not gather it
    found = Grouping.of(long, [*by, "loss"]).stats(long, specs)
    return found.withColumn("median", F.col("median")[0])


def option_log(options: DataFrame, keys: Sequence[str], position: str = "position") -> DataFrame:
    """T6, S10. ``method:prob`` of the most probable option per feature; the earlier option wins ties."""
    best = F.min_by(F.struct("option", "prob"), F.struct((-F.col("prob")).alias("p"), F.col(position).alias("o")))
    picked = options.groupBy(*keys).agg(best.alias("_best"))
    return picked.select(*keys, F.format_string("%s:%.2f", "_best.option", "_best.prob").alias("choice"))
