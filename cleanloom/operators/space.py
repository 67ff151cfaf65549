"""The preparation space, option probabilities, and applying mixtures or single options."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.operators import options as opt
from cleanloom.operators.bins import quantile_option, uniform_option
from cleanloom.operators.impute import FILLS, imputer_option
from cleanloom.operators.impute_chain import filled_by_chains, impute_chain
from cleanloom.operators.impute_knn import impute_knn
from cleanloom.operators.local import unchanged
from cleanloom.operators.options import Option
from cleanloom.operators.outliers import CLEANERS, cleaner_option
from cleanloom.operators.scale import SCALERS, scaler_option
from cleanloom.plans.grouping import Grouping, grouping
from cleanloom.plans.nearest import donor_means
from cleanloom.session import cut


@dataclass(frozen=True)
class Step:
    """A preparation step: its options, the default one, and the starting probability of the preferred one."""

    name: str
    options: tuple[Option, ...]
    default: str
    start: tuple[str, float]

    def option(self, name: str) -> Option:
        for o in self.options:
            if o.name == name:
                return o
        raise ValueError(f"step {self.name!r} has no option {name!r}")


# imputers that are no column expression: each fills a copy of all source columns once, which all chains share
MODEL_FILLS = {"knn": impute_knn, "mice": impute_chain}
# the same within a task, for the rows (n, sources) of several groups; of equally near donors the first ones are taken
LOCAL_MODELS = {
    "knn": lambda x, train, ends: np.concatenate([donor_means(x[a:b], train[a:b], 5) for a, b in zip(ends[:-1], ends[1:], strict=True)]),
    "mice": filled_by_chains,
}


def preparation_space(models: bool = False) -> list[Step]:
    """The four steps in their fixed order. With ``models`` the imputers include nearest rows and chained equations,
    which need ``row_id`` where they are applied."""
    imputers = [*(imputer_option(m) for m in FILLS), *(opt.Option(m, model=m, local=unchanged) for m in MODEL_FILLS if models)]
    bins = [make(n) for make in (uniform_option, quantile_option) for n in (5, 10, 20)]
    return [
        Step("missing_value_imputation", tuple(imputers), "mean", ("mean", 0.5)),
        Step("normalization", tuple(scaler_option(k) for k in SCALERS), "ZS", ("ZS", 0.5)),
        Step("cleaning_outliers", tuple(cleaner_option(r) for r in CLEANERS), "identity", ("identity", 0.5)),
        Step("discretization", (*bins, opt.IDENTITY), "identity", ("identity", 0.5)),
    ]


def apply_chains(
    df: DataFrame,
    g: Grouping,
    chains: Mapping[str, tuple[str, Sequence[Option]]],
    is_train: Column | None = None,
    row_id: Sequence[str] = (),
) -> DataFrame:
    """Add one column per chain: ``{new column: (source, options in order)}``.

    Chains that begin with the same options on the same source share those columns, and each position of all chains
    is fitted together. Model fillings run first, over all sources at once, and are written once.
    """
    filled = with_model_fills(df, g, chains, is_train, row_id)
    out = g.each(filled, lambda rows, part: _apply_chains(rows, part, chains, is_train))
    return out.drop(*[c for c in filled.columns if c not in df.columns])


def _filled(model: str, column: str) -> str:
    return f"_fill_{model}_{column}"


def with_model_fills(
    df: DataFrame, g: Grouping, chains: Mapping[str, tuple[str, Sequence[Option]]], is_train: Column | None, row_id: Sequence[str]
) -> DataFrame:
    """Add the model fillings that ``chains`` begin with and ``df`` does not have yet, and write the result once."""
    sources = list(dict.fromkeys(source for source, _ in chains.values()))
    models = sorted({chain[0].model for _, chain in chains.values() if chain and chain[0].model})
    models = [m for m in models if _filled(m, sources[0]) not in df.columns]
    if not models:
        return df
    if not row_id:
        raise ValueError(f"the imputers {models} need row_id")
    out = df
    for m in models:
        copies = {_filled(m, c): F.col(c).cast("double") for c in sources}
        out = MODEL_FILLS[m](out.withColumns(copies), g, list(copies), row_id, is_train)
    return cut(out)


def _apply_chains(df: DataFrame, g: Grouping, chains, is_train: Column | None) -> DataFrame:
    out = df
    made: dict[tuple, str] = {}
    depth = max((len(o) for _, o in chains.values()), default=0)
    for level in range(1, depth + 1):
        work: dict[str, tuple[str, Option]] = {}
        for source, chain in chains.values():
            if len(chain) < level:
                continue
            prefix = (source, *[o.name for o in chain[:level]])
            if prefix not in made:
                first = _filled(chain[0].model, source) if chain[0].model else source
                before = made[prefix[:-1]] if level > 1 else first
                made[prefix] = f"_p{len(made)}"
                work[made[prefix]] = (before, chain[level - 1])
        out = opt.run(out, g, work, is_train)
    named = {
        new: F.col(made[(source, *[o.name for o in chain])] if chain else source).cast("double")
        for new, (source, chain) in chains.items()
    }
    return out.withColumns(named).drop(*made.values())


def prepare(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    choice: Mapping[str, Sequence[str]],
    is_train: Column | None = None,
    space: Sequence[Step] | None = None,
    row_id: Sequence[str] = (),
) -> DataFrame:
    """Replace each column by the result of its chosen options, one name per step."""
    steps = list(space or preparation_space(bool(row_id)))
    chains = {
        f"_n_{c}": (c, [s.option(n) for s, n in zip(steps, names, strict=True)]) for c, names in choice.items()
    }
    out = apply_chains(df, grouping(df, keys), chains, is_train, row_id)
    return out.withColumns({c: F.col(f"_n_{c}") for c in choice}).drop(*chains)


def prepare_default(
    df: DataFrame, keys: Sequence[str] | Grouping, columns: Sequence[str], is_train: Column | None = None
) -> DataFrame:
    """R1. The default option of every step for every column."""
    space = preparation_space()
    return prepare(df, keys, {c: [s.default for s in space] for c in columns}, is_train, space)


# -- probabilities --------------------------------------------------------------------------------------------------


def starting_probabilities(options: DataFrame, by: Sequence[str], start: str, p: float) -> DataFrame:
    """R9. ``prob`` = p for the starting option and an equal share of 1 - p for the others; 1 for a single option.

    ``options`` has one row per (``by``, option); the boolean column ``start`` marks the starting option.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    others = (1 - F.lit(p)) / F.nullif(n - 1, F.lit(0))
    return options.withColumn("prob", F.when(n == 1, 1.0).when(F.col(start), p).otherwise(others))


def softmax(options: DataFrame, by: Sequence[str], logit: str, out: str = "prob") -> DataFrame:
    """R9. Logits to probabilities inside each ``by`` group (one row per option)."""
    group = Window.partitionBy(*by)
    weight = F.exp(F.col(logit) - F.max(logit).over(group))
    weighted = options.withColumn("_w", weight)
    return weighted.withColumn(out, F.col("_w") / F.sum("_w").over(group)).drop("_w")


def best_options(options: DataFrame, by: Sequence[str], position: str = "position") -> DataFrame:
    """R7. The most probable option per group, the earlier one on ties."""
    best = F.min_by("option", F.struct((-F.col("prob")).alias("p"), F.col(position).alias("o")))
    return options.groupBy(*by).agg(best.alias("option"))


def best_config(options: DataFrame, keys: Sequence[str], feature: str = "feature", order: str = "feature_no") -> DataFrame:
    """R8. Names of the most probable option per feature, as an array in feature order. One row per key and step."""
    picked = best_options(options, [*keys, feature, order])
    cells = F.array_sort(F.collect_list(F.struct(order, "option")))
    return picked.groupBy(*keys).agg(F.transform(cells, lambda c: c["option"]).alias("options"))


def mixture(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    columns: Sequence[str],
    step_options: Sequence[Option],
    probabilities: DataFrame,
    is_train: Column | None = None,
    only_best: bool = False,
) -> DataFrame:
    """R6, R7. Each column becomes the probability-weighted sum of all options applied to it, or with ``only_best``
    the result of its most probable option.

    ``probabilities`` has feature, option, prob: one row per column and option, so its size is fixed by the space.
    """
    g = grouping(df, keys)
    cells = [(c, o) for c in columns for o in step_options]
    weights = probabilities
    if only_best:
        order = F.array_position(F.array(*[F.lit(o.name) for o in step_options]), F.col("option"))
        best = best_options(probabilities.withColumn("_at", order), ["feature"], "_at").withColumnRenamed("option", "_best")
        weights = probabilities.join(best, "feature").withColumn(
            "prob", F.when(F.col("option") == F.col("_best"), 1.0).otherwise(0.0)
        )
    row = weights.agg(
        *[
            F.max(F.when((F.col("feature") == c) & (F.col("option") == o.name), F.col("prob"))).alias(f"_w{i}")
            for i, (c, o) in enumerate(cells)
        ]
    )
    out = opt.run(df, g, {f"_v{i}": (c, o) for i, (c, o) in enumerate(cells)}, is_train)
    out = Grouping([], None, False, g.max_rows).attach(out, row)
    mixed = {}
    for c in columns:
        terms = [
            # an option of weight 0 must not turn the sum into NULL
            F.when(F.coalesce(F.col(f"_w{i}"), F.lit(0.0)) != 0, F.col(f"_w{i}") * F.col(f"_v{i}")).otherwise(0.0)
            for i, (name, _) in enumerate(cells)
            if name == c
        ]
        mixed[c] = sum(terms[1:], terms[0])
    return out.withColumns(mixed).drop(*[f"_{n}{i}" for n in ("v", "w") for i in range(len(cells))])


def balance(matrix: DataFrame, by: Sequence[str], eps: float = 1e-6, rounds: int = 500) -> DataFrame:
    """R10. Balance ``exp(v)`` per group until all column and row sums are 1: columns first, then rows.

    Long form: by, i, j, v. A matrix is as large as a step has options, so one task holds one matrix.
    """
    names = [*by, "i", "j"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in matrix.schema if f.name in names)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.exp(pdf.pivot(index="i", columns="j", values="v").sort_index().sort_index(axis=1))
        for _ in range(rounds):
            columns = x.sum(axis=0)
            x = x / columns
            rows = x.sum(axis=1)
            x = x.div(rows, axis=0)
            if (columns - 1).abs().max() < eps and (rows - 1).abs().max() < eps:
                break
        long = x.stack().rename("v").reset_index()
        return long.assign(**{k: pdf[k].iloc[0] for k in by})[[*names, "v"]]

    ordered = matrix.select(*names, "v")
    return ordered.groupBy(*by).applyInPandas(solve, f"{types}, v double")


# -- grids ----------------------------------------------------------------------------------------------------------


def grid_candidates(params: Mapping[str, object]) -> list[dict[str, object]]:
    """R11. All combinations of the list-valued parameters, the others fixed; the last parameter varies fastest."""
    lists = {n: v for n, v in params.items() if isinstance(v, list)}
    fixed = {n: v for n, v in params.items() if not isinstance(v, list)}
    return [{**fixed, **dict(zip(lists, values, strict=True))} for values in product(*lists.values())]


def best_candidate(
    df: DataFrame, keys: Sequence[str], params: Mapping[str, object], loss: Callable[[Mapping[str, Column]], Column]
) -> DataFrame:
    """R11. The candidate with the smallest mean loss per key; the earlier candidate wins ties.

    ``loss`` turns the parameter columns into a row loss. Candidates become rows, summed before the shuffle.
    """
    found = grid_candidates(params)
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("candidate"), *[F.lit(v).alias(n) for n, v in c.items()])
            for i, c in enumerate(found)
        ]
    )
    names = list(found[0])
    spread = df.withColumn("_c", F.explode(rows))
    scored = (
        spread.withColumn("_loss", loss({n: F.col(f"_c.{n}") for n in names}))
        .groupBy(*keys, "_c")
        .agg(F.avg("_loss").alias("loss"))
    )
    best = F.min_by(F.struct("_c", "loss"), F.struct("loss", F.col("_c.candidate")))
    return scored.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b._c.*", "_b.loss")
