"""Searching the preparation space per series.

Every option chain of every feature is a column. The sums of products of all of them are taken once per (series,
split); any combination of choices is then scored on a small sub-matrix, without touching the data again. A series that fits
a task is prepared and searched there; the columns and sums of larger ones are distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import count, permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cleanloom.operators import local
from cleanloom.operators import options as opt
from cleanloom.operators.encode import label_encode
from cleanloom.operators.local import Groups
from cleanloom.operators.options import Option
from cleanloom.operators.scale import scaler_option
from cleanloom.operators.space import LOCAL_MODELS, Step, apply_chains, preparation_space, with_model_fills
from cleanloom.plans import gram as G
from cleanloom.plans.grouping import Grouping, grouping, groups_together
from cleanloom.plans.nearest import BLOCK
from cleanloom.plans.ordered import join_on

SPLITS = ("train", "val", "test")
TARGETS = ("value", "rank")
# the column of the standardised target
TARGET = "_y"
PENALTY = 1e-3
# random preparations whose columns stand in one plan
SEEDS_AT_ONCE = 25

Chain = tuple[Option, ...]


def fixed_chains(space: Sequence[Step], steps: Sequence[str]) -> list[Chain]:
    """All option combinations of the named steps in the space's order."""
    out: list[Chain] = [()]
    for step in space:
        if step.name in steps:
            out = [(*c, o) for c in out for o in step.options]
    return out


def flexible_chains(space: Sequence[Step], picks: Sequence[str] = ("ZS", "ZS_3", "uniform_10")) -> list[Chain]:
    """Every imputer, followed by one scaler, one cleaner and one binning in each of their six orders."""
    first, *others = space
    chosen = [step.option(name) for step, name in zip(others, picks, strict=True)]
    return [(imputer, *order) for imputer in first.options for order in permutations(chosen)]


def chain_name(chain: Chain) -> str:
    return ">".join(o.name for o in chain)


def default_position(chains: Sequence[Chain], space: Sequence[Step]) -> int:
    """The chain made of default options, or the first one."""
    defaults = {s.default for s in space}
    for i, c in enumerate(chains):
        if all(o.name in defaults for o in c):
            return i
    return 0


def candidate_sums(
    df: DataFrame, g: Grouping, columns: Sequence[str], row_id: Sequence[str], split: str = "split"
) -> DataFrame:
    """Sums of products of many columns per (keys, split), as partial sums of one row per task and group.

    Rows are brought together by key; a hot key is spread over several tasks. Tasks stream their rows in batches.
    """
    keys, names = g.keys, list(columns)
    by = [*keys, split]
    rows = df.select(*by, *row_id, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    share = F.lit(0)
    if g.hot is not None and keys:
        rows = join_on(rows, g.hot, keys, "left", small=True)
        tasks = F.ceil(F.coalesce(F.col("_n"), F.lit(1)) / g.max_rows)
        share = F.pmod(F.xxhash64(*row_id), tasks)
    elif not keys:
        share = F.pmod(F.xxhash64(*row_id), F.lit(max(1, -(-rows.count() // g.max_rows))))
    placed = rows.withColumn("_share", share).repartition(*keys, "_share").sortWithinPartitions(*by)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name in by)
    upper = np.triu_indices(len(names) + 1)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, total = None, None
        for batch in batches:
            for name, part in batch.groupby(by, sort=False, dropna=False):
                name = tuple(None if pd.isna(v) else v for v in name)
                z = np.column_stack([np.ones(len(part)), part[names].to_numpy(dtype=float)])
                sums = (z.T @ z)[upper]
                if name == group:
                    total += sums
                    continue
                if group is not None:
                    yield pd.DataFrame([[*group, total]], columns=[*by, "gram"], dtype=object)
                group, total = name, sums
        if group is not None:
            yield pd.DataFrame([[*group, total]], columns=[*by, "gram"], dtype=object)

    return placed.select(*by, *names).mapInPandas(partial, f"{types}, gram array<double>")


def _descend(train: np.ndarray, val: np.ndarray, d: int, m: int, start: int, rounds: int | None):
    """Coordinate search: one feature at a time takes the option with the smallest validation loss."""
    choice = [start] * d
    columns = lambda picks: np.array([0, *[1 + f * m + o for f, o in enumerate(picks)], 1 + d * m])

    def losses(batch: list[list[int]]) -> np.ndarray:
        at = np.stack([columns(p) for p in batch])
        fit = G.ridge(train[at[:, :, None], at[:, None, :]], PENALTY, True)
        return G.mean_squared_error(val[at[:, :, None], at[:, None, :]], fit)

    best = float(losses([choice])[0])
    for _ in count() if rounds is None else range(rounds):
        changed = False
        for f in range(d):
            tried = losses([[*choice[:f], o, *choice[f + 1 :]] for o in range(m)])
            at = int(np.nanargmin(tried)) if not np.isnan(tried).all() else choice[f]
            if tried[at] < best - 1e-12:
                choice[f], best, changed = at, float(tried[at]), True
        if not changed:
            break
    at = columns(choice)
    return choice, best, at, G.ridge(train[np.ix_(at, at)][None], PENALTY, True)


def search_chains(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    features: Sequence[str],
    target: str,
    chains: Sequence[Chain],
    row_id: Sequence[str],
    start: int = 0,
    split: str = "split",
    rounds: int | None = None,
    target_as: str = "value",
) -> DataFrame:
    """Choose one chain per feature and key so that a linear model's validation loss is small.

    Starts with chain ``start`` for all features. One row per key: chosen chain names in feature order, the losses of
    the start and of the result, in units of the standardised training target. Rounds over the features go on until
    none improves, or for ``rounds``. ``target_as="rank"`` takes the dense rank of the target among all rows of the key.
    """
    labels, d, m = [chain_name(c) for c in chains], len(features), len(chains)

    def choose(total: Mapping[str, np.ndarray]) -> dict[str, object]:
        choice, best, at, w = _descend(total["train"], total["val"], d, m, start, rounds)
        _, first, _, _ = _descend(total["train"], total["val"], d, m, start, 0)
        loss = {s: float(G.mean_squared_error(total[s][np.ix_(at, at)][None], w)[0]) for s in SPLITS}
        return {
            "start_val_loss": first, "best_val_loss": best, "best_tr_loss": loss["train"], "best_test_loss": loss["test"],
            "choices": [labels[o] for o in choice],
        }

    columns = "start_val_loss double, best_val_loss double, best_tr_loss double, best_test_loss double, choices array<string>"
    return solve_by_key(df, keys, features, target, chains, row_id, choose, columns, split, target_as)


def solve_by_key(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    features: Sequence[str],
    target: str,
    chains: Sequence[Chain],
    row_id: Sequence[str],
    solve: Callable[[Mapping[str, np.ndarray]], dict[str, object]],
    columns: str,
    split: str = "split",
    target_as: str = "value",
    group_rows: int = BLOCK,
) -> DataFrame:
    """One row per key with what ``solve`` makes of the sums of products per split (see :func:`option_sums`).

    A group of up to ``group_rows`` rows is prepared, summed up and solved in one task, so that neither the option columns
    nor their sums are ever shuffled. Larger ones go through :func:`option_sums`.
    """
    wanted = _option_columns(features, chains)
    order = [*wanted, TARGET]

    def of_groups(made: Mapping[str, np.ndarray], splits: np.ndarray, groups: Groups) -> list[list[dict[str, object]]]:
        z = np.column_stack([np.ones(len(splits)), *[np.nan_to_num(made[n], nan=0.0, posinf=np.inf, neginf=-np.inf) for n in order]])
        return [[solve(split_sums(z[p], splits[p]))] for p in groups.parts()]

    def of_sums(hot: DataFrame, g: Grouping) -> DataFrame:
        sums = option_sums(hot, g, features, target, chains, row_id, split, target_as)
        by = g.keys or ["_all"]
        sums = sums if g.keys else sums.withColumn("_all", F.lit(0))
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in by)

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            size = len(order) + 1
            total = {s: np.zeros((size, size)) for s in SPLITS}
            for s, packed in zip(pdf[split], pdf["gram"], strict=True):
                if s in total:
                    total[s] += G.square(np.asarray(packed)[None])[0]
            out = pdf[by].head(1).astype(object)
            for name, value in solve(total).items():
                out[name] = pd.Series([value], index=out.index, dtype=object if isinstance(value, list) else float)
            return out

        result = sums.groupBy(*by).applyInPandas(choose, f"{types}, {columns}")
        return result if g.keys else result.drop("_all")

    return _in_tasks_or_sums(df, keys, wanted, target, row_id, of_groups, of_sums, columns, split, target_as, group_rows)


def split_sums(z: np.ndarray, splits: np.ndarray) -> dict[str, np.ndarray]:
    """Sums of products of the columns of ``z`` over the rows of each split."""
    out = {}
    for i, s in enumerate(SPLITS):
        part = z[splits == i]
        out[s] = part.T @ part
    return out


def _in_tasks_or_sums(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    wanted: Mapping[str, tuple[str, Chain]],
    target: str,
    row_id: Sequence[str],
    of_groups: Callable[[Mapping[str, np.ndarray], np.ndarray, Groups], list[list[dict[str, object]]]],
    of_sums: Callable[[DataFrame, Grouping], DataFrame],
    columns: str,
    split: str,
    target_as: str,
    group_rows: int,
) -> DataFrame:
    """Keys and ``columns``: groups that a task holds through ``of_groups``, which gets the columns of all chains and
    the standardised target and returns the rows of each group; larger ones, and options unknown within a task, through
    ``of_sums``."""
    if target_as not in TARGETS:
        raise ValueError("target_as must be 'value' or 'rank'")
    models = sorted({o.model for _, chain in wanted.values() for o in chain[:1] if o.model})
    if models and not row_id:
        raise ValueError(f"the imputers {models} need row_id")
    if not local.can_run(wanted, LOCAL_MODELS):
        return of_sums(df, grouping(df, keys))
    g = keys if isinstance(keys, Grouping) and keys.is_bounded else Grouping.of(df, keys.keys if isinstance(keys, Grouping) else keys, group_rows)
    cold, hot = g.split(df)
    parts = []
    if cold is not None:
        sources = list(dict.fromkeys(source for source, _ in wanted.values()))
        parts.append(_solve_in_tasks(cold, g.keys, sources, wanted, target, row_id, models, of_groups, columns, split, target_as))
    if hot is not None:
        parts.append(of_sums(hot, Grouping.of(hot, g.keys)))
    return reduce(DataFrame.unionByName, parts)


def _solve_in_tasks(df, keys, sources, wanted, target, row_id, models, of_groups, columns, split, target_as) -> DataFrame:
    narrow = df.where(F.col(target).isNotNull()).select(
        *keys, *[F.col(c).alias(f"_id{i}") for i, c in enumerate(row_id)], *[F.col(c).cast("double").alias(f"_s{i}") for i, c in enumerate(sources)],
        (F.col(target).cast("double") if target_as == "value" else F.col(target)).alias("_y"),
        F.coalesce(*[F.when(F.col(split) == s, F.lit(i)) for i, s in enumerate(SPLITS)], F.lit(-1)).alias("_split"),
    )

    def solve(rows: pa.Table, ends: np.ndarray) -> pa.Table:
        x = np.column_stack([rows.column(f"_s{i}").to_numpy() for i in range(len(sources))]).astype(float)
        if models:
            # equally near donors follow the order of missing pattern, first coordinate and row id
            pattern = np.isnan(x) @ (1 << np.arange(x.shape[1]))
            owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            names = ["_owner", "_pattern", "_s0", *[f"_id{i}" for i in range(len(row_id))]]
            placed = rows.append_column("_owner", pa.array(owner)).append_column("_pattern", pa.array(pattern))
            by = pc.sort_indices(placed.select(names), [(c, "ascending") for c in names], null_placement="at_start")
            rows, x = rows.take(by), x[by.to_numpy()]
        splits = rows.column("_split").to_numpy()
        groups = Groups(ends, splits == 0)
        fills = {}
        for m in models:
            for source, column in zip(sources, LOCAL_MODELS[m](x, splits == 0, ends).T, strict=True):
                fills[m, source] = column
        made = local.apply_chains(dict(zip(sources, x.T, strict=True)), fills, groups, wanted)
        y = rows.column("_y").to_numpy()
        if target_as == "rank":
            y = np.concatenate([np.unique(y[p], return_inverse=True)[1] for p in groups.parts()])
        made[TARGET] = scaler_option("ZS").local(y.astype(float), groups)
        found = of_groups(made, splits, groups)
        first = pa.array(np.repeat(ends[:-1], [len(f) for f in found]))
        flat = [row for f in found for row in f]
        cells = [*[rows.column(k).take(first) for k in keys], *[pa.array([row[f.name] for row in flat], f.type, from_pandas=True) for f in result]]
        return pa.Table.from_arrays(cells, names=[*keys, *result.names])

    result = to_arrow_schema(StructType.fromDDL(columns))
    key_types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema if f.name in keys)
    return groups_together(narrow, keys, solve, f"{key_types}{columns}")


def _option_columns(features: Sequence[str], chains: Sequence[Chain]) -> dict[str, tuple[str, Chain]]:
    return {f"_x{f}_{o}": (c, chain) for f, c in enumerate(features) for o, chain in enumerate(chains)}


def option_sums(
    df: DataFrame, g: Grouping, features: Sequence[str], target: str, chains: Sequence[Chain], row_id: Sequence[str], split: str = "split", target_as: str = "value"
) -> DataFrame:
    """Sums of products of every chain of every feature, in this order, and the standardised target, per (keys, split)."""
    train = F.col(split) == "train"
    df, target = _shaped_target(df, g, target, target_as)
    wanted = _option_columns(features, chains)
    ready = apply_chains(df, g, wanted, train, row_id)
    ready = opt.run(ready, g, {TARGET: (target, scaler_option("ZS"))}, train)
    return candidate_sums(ready, g, [*wanted, TARGET], row_id, split)


def _shaped_target(df: DataFrame, g: Grouping, target: str, target_as: str) -> tuple[DataFrame, str]:
    """Rows with a target, and the column to predict: the target or its dense rank inside the key (N-Y)."""
    if target_as not in TARGETS:
        raise ValueError("target_as must be 'value' or 'rank'")
    rows = df.where(F.col(target).isNotNull())
    return (rows, target) if target_as == "value" else (label_encode(rows, target, "_target_rank", g.keys), "_target_rank")


def search_fixed(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    features: Sequence[str],
    target: str,
    row_id: Sequence[str],
    steps: Sequence[str] = ("missing_value_imputation", "normalization"),
    extra: Sequence[Option] = (),
    target_as: str = "value",
) -> DataFrame:
    """R4. Options of the steps in their fixed order, chosen per feature. ``extra`` are further imputers."""
    space = preparation_space(models=True)
    if extra:
        first = space[0]
        space[0] = Step(first.name, (*first.options, *extra), first.default, first.start)
    chains = fixed_chains(space, steps)
    return search_chains(df, keys, features, target, chains, row_id, default_position(chains, space), target_as=target_as)


def search_flexible(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    features: Sequence[str],
    target: str,
    row_id: Sequence[str],
    picks: Sequence[str] = ("ZS", "ZS_3", "uniform_10"),
) -> DataFrame:
    """R5. The order of scaling, cleaning and binning is chosen per feature as well."""
    return search_chains(df, keys, features, target, flexible_chains(preparation_space(models=True), picks), row_id)


# -- random search --------------------------------------------------------------------------------------------------


def random_candidates(
    space: Sequence[Step], seeds: int, features: Sequence[str] | None = None
) -> list[dict[str, list[str]]]:
    """R2, R3. Per seed one random option per step, the same for all features, or one per feature when given."""
    out = []
    for seed in range(seeds):
        picks = {}
        for f, feature in enumerate(features or [""]):
            draw = np.random.default_rng([seed, f])
            picks[feature] = [s.options[int(draw.integers(len(s.options)))].name for s in space]
        out.append(picks)
    return out


def random_search(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    features: Sequence[str],
    target: str,
    seeds: int = 20,
    per_feature: bool = False,
    split: str = "split",
    space: Sequence[Step] | None = None,
    row_id: Sequence[str] = (),
    target_as: str = "value",
    group_rows: int = BLOCK,
) -> DataFrame:
    """R2, R3. Losses of ``seeds`` random preparations per key: keys, seed, best_val_loss, best_tr_loss, best_test_loss.

    With ``row_id`` the imputers include nearest rows and chained equations."""
    steps = list(space or preparation_space(bool(row_id)))
    found = random_candidates(steps, seeds, features if per_feature else None)
    chains = {}
    for s, picks in enumerate(found):
        for f, c in enumerate(features):
            names = picks[c] if per_feature else picks[""]
            chains[f"_x{s}_{f}"] = (c, tuple(step.option(n) for step, n in zip(steps, names, strict=True)))
    n = len(features) + 1

    def of_groups(made: Mapping[str, np.ndarray], splits: np.ndarray, groups: Groups) -> list[list[dict[str, object]]]:
        names = list(chains)
        z = np.column_stack([np.ones(len(splits)), *[np.nan_to_num(made[c], nan=0.0, posinf=np.inf, neginf=-np.inf) for c in names], made[TARGET]])
        at = np.array([[0, *[1 + names.index(f"_x{s}_{f}") for f in range(n - 1)], len(names) + 1] for s in range(seeds)])
        out = []
        for p in groups.parts():
            total = split_sums(z[p], splits[p])
            losses = _losses(*[total[s][at[:, :, None], at[:, None, :]] for s in SPLITS])
            out.append([{"seed": i, **dict(zip(losses, found, strict=True))} for i, found in enumerate(zip(*losses.values(), strict=True))])
        return out

    def of_sums(hot: DataFrame, g: Grouping) -> DataFrame:
        return _random_losses(hot, g, features, target, chains, seeds, split, row_id, target_as)

    return _in_tasks_or_sums(df, keys, chains, target, row_id, of_groups, of_sums, f"seed int, {LOSSES}", split, target_as, group_rows)


def _random_losses(df: DataFrame, g: Grouping, features, target: str, chains, seeds: int, split: str, row_id, target_as: str) -> DataFrame:
    """The losses of all seeds through distributed sums of products."""
    train = F.col(split) == "train"
    df, target = _shaped_target(df, g, target, target_as)
    filled = with_model_fills(df, g, chains, train, row_id)
    n = len(features) + 1

    def sums(first: int) -> DataFrame:
        """Sums of products of the seeds from ``first``; a plan of all seeds would be too long to compile."""
        some = range(first, min(first + SEEDS_AT_ONCE, seeds))
        ready = apply_chains(filled, g, {f"_x{s}_{f}": chains[f"_x{s}_{f}"] for s in some for f in range(n - 1)}, train, row_id)
        ready = opt.run(ready, g, {"_y": (target, scaler_option("ZS"))}, train)
        cases = [
            F.struct(
                F.lit(s).alias("seed"),
                F.array(*[F.coalesce(F.col(f"_x{s}_{f}"), F.lit(0.0)) for f in range(n - 1)], F.col("_y")).alias("_x"),
            )
            for s in some
        ]
        long = ready.select(*g.keys, split, F.inline(F.array(*cases)))
        return G.gram(long, [*g.keys, "seed", split], [F.col("_x")[i] for i in range(n)])

    grams = reduce(DataFrame.unionByName, [sums(first) for first in range(0, seeds, SEEDS_AT_ONCE)])
    wide = grams.groupBy(*g.keys, "seed").agg(
        *[F.max(F.when(F.col(split) == s, F.col("gram"))).alias(f"_{s}") for s in SPLITS]
    )
    return wide.select(*g.keys, "seed", _losses_udf(n)(*[f"_{s}" for s in SPLITS]).alias("_l")).select(
        *g.keys, "seed", "_l.*"
    )


LOSSES = "best_val_loss double, best_tr_loss double, best_test_loss double"


def _losses(train: np.ndarray, val: np.ndarray, test: np.ndarray) -> dict[str, np.ndarray]:
    w = G.ridge(train, PENALTY, True)
    return {
        "best_val_loss": G.mean_squared_error(val, w),
        "best_tr_loss": G.mean_squared_error(train, w),
        "best_test_loss": G.mean_squared_error(test, w),
    }


def _losses_udf(n: int):
    width = (n + 1) * (n + 2) // 2

    @F.pandas_udf(LOSSES)
    def losses(train: pd.Series, val: pd.Series, test: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_losses(*[G.square(G.stack(x, width)) for x in (train, val, test)]))

    return losses


def best_by_seed(
    losses: DataFrame, keys: Sequence[str], loss: str = "best_val_loss", snapshots: Sequence[int] = (20, 50)
) -> DataFrame:
    """R2. Best seed and loss per key after each snapshot's number of seeds; earlier seeds win ties."""
    so_far = Window.partitionBy(*keys).orderBy("seed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.min(F.struct(F.col(loss).alias("loss"), F.col("seed").alias("best_seed"))).over(so_far)
    ranked = losses.withColumn("_best", best).withColumn("seeds", F.col("seed") + 1)
    return ranked.where(F.col("seeds").isin(list(snapshots))).select(*keys, "seeds", "_best.best_seed", "_best.loss")


def choice_log(result: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chosen options split by step, in the array form that the reports read: num_tf and normalization per key."""

    def part(i: int) -> Column:
        return F.transform("choices", lambda c: F.try_element_at(F.split(c, ">"), F.lit(i)))

    return result.select(*keys, part(1).alias("num_tf"), part(2).alias("normalization"))
