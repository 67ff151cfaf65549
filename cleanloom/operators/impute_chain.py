"""Chained-equation imputation and Gaussian EM.

Both work on columns standardised by the observed training values, so the sums of products stay well conditioned. Only
incomplete rows ever change: complete rows are summed once, and every round reads the small set of incomplete rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.columns import any_null
from cleanloom.operators.trees import TREE_ROUNDS, Growth, chain_trees_in_rounds, chains_with_trees
from cleanloom.plans import gram as G
from cleanloom.plans import stats as st
from cleanloom.plans.grouping import Grouping, groups_together
from cleanloom.plans.nearest import BLOCK, nearest, nearest_means
from cleanloom.plans.ordered import join_on
from cleanloom.session import cut

# a light ridge keeps collinear columns solvable
PENALTY = 1e-3
ROUNDS = 10
TOLERANCE = 1e-3
# expectation maximisation: the most rounds, and the largest move of a mean or mean product that counts as none
EM_ROUNDS, EM_TOLERANCE = 50, 1e-3
# rounds of a chain of ridge regressions at most; each group stops as soon as a round moves nothing by more than TOLERANCE
MOST_ROUNDS = 100
# rows of one group that one task may hold as a matrix
GROUP_ROWS = 200_000


def chain_matrix(z: np.ndarray, train: np.ndarray, rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Fill a standardised (n, d) matrix: start at the mean, then predict each incomplete column from the others.

    Models are fitted on training rows that have the column; predictions replace the missing cells of all rows. It ends
    when a round moves no cell by more than ``tolerance`` times the largest value of the incomplete rows at the start.
    """
    missing = np.isnan(z)
    out = np.where(missing, 0.0, z)
    todo = np.flatnonzero(missing.any(axis=0))
    largest = np.abs(out[missing.any(axis=1)]).max(initial=0.0)
    for _ in range(rounds):
        change = 0.0
        for j in todo:
            fit = train & ~missing[:, j]
            if not fit.any():
                continue
            others = np.delete(out, j, axis=1)
            design = np.column_stack([np.ones(fit.sum()), others[fit], out[fit, j]])
            w = G.ridge((design.T @ design)[None], PENALTY, True)[0]
            new = w[0] + others[missing[:, j]] @ w[1:]
            change = max(change, np.abs(new - out[missing[:, j], j]).max(initial=0.0))
            out[missing[:, j], j] = new
        if change <= tolerance * largest:
            break
    return out


def impute_chain(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    columns: Sequence[str],
    row_id: Sequence[str],
    is_train: Column | None = None,
    rounds: int | None = None,
    group_rows: int = GROUP_ROWS,
    estimator: str = "ridge",
    growth: Growth | None = None,
) -> DataFrame:
    """I5 with ridge regressions, or ``estimator="tree"`` with regression trees, for every group. Groups of at most ``group_rows`` rows are solved in one task each; larger ones by
    the same rounds with distributed sums. Each group stops by itself, by one rule on both paths, after ``rounds`` at
    most. ``row_id`` must identify a row inside its group."""
    if estimator not in MATRICES:
        raise ValueError(f"unknown estimator {estimator!r}; use one of {sorted(MATRICES)}")
    rounds = most_rounds(estimator) if rounds is None else rounds
    train = F.lit(True) if is_train is None else is_train
    g = keys if isinstance(keys, Grouping) and keys.is_bounded else Grouping.of(
        df, keys.keys if isinstance(keys, Grouping) else keys, group_rows
    )
    marked = df.withColumn("_train", F.coalesce(train, F.lit(False)))
    cold, hot = g.split(marked)
    parts = []
    if cold is not None:
        parts.append(_chain_in_tasks(cold, g.keys, columns, rounds, estimator, growth))
    if hot is not None:
        if estimator == "ridge":
            parts.append(_chain_in_rounds(hot, g, columns, row_id, rounds))
        else:
            parts.append(_tree_chain_in_rounds(hot, g, columns, row_id, rounds, growth or Growth()))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.drop("_train")


def chain_matrices(z: np.ndarray, train: np.ndarray, ends: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """:func:`chain_matrix` of several groups, whose rows lie between ``ends``."""
    return np.concatenate([chain_matrix(z[a:b], train[a:b], rounds, tolerance) for a, b in zip(ends[:-1], ends[1:], strict=True)])


#: What fills the standardised matrices of several groups within a task, by estimator.
MATRICES = {"ridge": chain_matrices, "tree": chains_with_trees}


def most_rounds(estimator: str) -> int:
    return TREE_ROUNDS if estimator == "tree" else MOST_ROUNDS


def filled_by_chains(x: np.ndarray, train: np.ndarray, ends: np.ndarray, matrices: Callable = chain_matrices, rounds: int = MOST_ROUNDS, **more) -> np.ndarray:
    """Values of several groups with their gaps filled by chained equations."""
    seen = [_observed(np.where(train[a:b, None], x[a:b], np.nan)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    mean, spread = (np.repeat(np.array(part), np.diff(ends), axis=0) for part in zip(*seen, strict=True))
    return np.where(np.isnan(x), matrices((x - mean) / spread, train, ends, rounds, TOLERANCE, **more) * spread + mean, x)


def _chain_in_tasks(df: DataFrame, keys: Sequence[str], columns: Sequence[str], rounds: int, estimator: str, growth: Growth | None) -> DataFrame:
    columns = list(columns)
    matrices, more = MATRICES[estimator], {"growth": growth} if growth else {}
    df = df.withColumns({c: F.col(c).cast("double") for c in columns})

    def fill(rows: pa.Table, ends: np.ndarray) -> pa.Table:
        x = np.column_stack([rows.column(c).to_numpy() for c in columns]).astype(float)
        filled = filled_by_chains(x, rows.column("_train").to_numpy().astype(bool), ends, matrices, rounds, **more)
        for i, c in enumerate(columns):
            rows = rows.set_column(rows.schema.get_field_index(c), c, pa.array(filled[:, i]))
        return rows

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return groups_together(df, keys, fill, types)


def _observed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of the present cells; 0 and 1 where there are none."""
    n = (~np.isnan(x)).sum(axis=0)
    mean = np.nansum(x, axis=0) / np.maximum(n, 1)
    spread = np.sqrt(np.nansum((x - mean) ** 2, axis=0) / np.maximum(n, 1))
    return mean, np.where(spread > 0, spread, 1.0)


def _standardised(df: DataFrame, g: Grouping, columns: Sequence[str]) -> DataFrame:
    """Add ``_z<i>``, ``_m<i>`` and ``_s<i>``: standardised value, mean and deviation of each column."""
    specs = {}
    for i, c in enumerate(columns):
        specs[f"_m{i}"], specs[f"_s{i}"] = st.mean(c).only(F.col("_train")), st.std(c).only(F.col("_train"))
    out = g.with_stats(df, specs)
    for i, c in enumerate(columns):
        out = out.withColumn(f"_m{i}", F.coalesce(f"_m{i}", F.lit(0.0))).withColumn(
            f"_s{i}", F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0)
        )
        out = out.withColumn(f"_z{i}", (F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}"))
    return out


def _finished(df: DataFrame, state: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Write the filled standardised values of incomplete rows back into the table."""
    filled = state.select(*ids, *[(F.col(f"_z{i}") * F.col(f"_s{i}") + F.col(f"_m{i}")).alias(f"_f{i}") for i in range(len(columns))])
    out = join_on(df, filled, ids, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_f{i}")) for i, c in enumerate(columns)}).drop(
        *[f"_f{i}" for i in range(len(columns))]
    )


def _shared(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Keys for grouping; a constant one when there are none."""
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def _chain_in_rounds(df, g: Grouping, columns, row_id, rounds) -> DataFrame:
    df, keys = _shared(df, g.keys)
    own = Grouping(keys, df.select(*keys).distinct(), False, g.max_rows)  # hot keys only: few
    d, ids = len(columns), [*keys, *row_id]
    z = [f"_z{i}" for i in range(d)]
    table = _standardised(df, own, columns)
    gaps = [f"_gap{i}" for i in range(d)]
    start = table.where(any_null(z)).select(
        *ids, "_train", *[f"_{n}{i}" for n in ("m", "s") for i in range(d)],
        *[F.col(c).isNull().alias(b) for c, b in zip(z, gaps, strict=True)],
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in z],
    )
    complete = cut(G.gram(table.where(F.col("_train") & ~any_null(z)), keys, z, "_base"))
    largest = start.groupBy(*keys).agg(F.max(F.greatest(*[F.abs(F.col(c)) for c in z])).alias("_largest"))
    state = cut(join_on(start, largest, keys, "left", small=True).withColumn("_done", F.lit(False)))
    width = (d + 1) * (d + 2) // 2
    for _ in range(rounds):
        state = state.withColumns({f"_old{c}": F.col(c) for c in z})
        for j in range(d):
            others = [i for i in range(d) if i != j]
            seen = state.where(F.col("_train") & ~F.col(gaps[j]))
            sums = G.gram(seen, keys, z, "_more")
            fitted = _sum_grams(complete, sums, keys, width)
            solved = fitted.select(*keys, _ridge_udf(j, width)("_gram").alias("_w"))
            state = join_on(state, solved, keys, "left", small=True)
            predicted = F.col("_w")[0] + sum(
                (F.col("_w")[p + 1] * F.col(z[i]) for p, i in enumerate(others)), F.lit(0.0)
            )
            state = state.withColumn(z[j], F.when(F.col(gaps[j]) & F.col("_w").isNotNull() & ~F.col("_done"), predicted).otherwise(F.col(z[j]))).drop("_w")
        state = cut(state)
        change = F.max(F.greatest(*[F.abs(F.col(c) - F.col(f"_old{c}")) for c in z]))
        moved = cut(state.groupBy(*keys).agg((change <= TOLERANCE * F.max("_largest")).alias("_still")))
        if moved.where(~F.col("_still")).isEmpty():
            break
        state = join_on(state.drop(*[f"_old{c}" for c in z]), moved, keys, "left", small=True)
        state = state.withColumn("_done", F.coalesce("_still", F.lit(True))).drop("_still")
    out = _finished(df, state, ids, columns)
    return out if g.keys else out.drop("_all")


def _tree_chain_in_rounds(df, g: Grouping, columns, row_id, rounds, growth: Growth) -> DataFrame:
    df, keys = _shared(df, g.keys)
    own = Grouping(keys, df.select(*keys).distinct(), False, g.max_rows)
    table, units = _standardised(df, own, columns), [f"_{n}{i}" for n in ("m", "s") for i in range(len(columns))]
    ids = [*keys, *row_id]
    state = chain_trees_in_rounds(table, keys, ids, len(columns), rounds, TOLERANCE, growth, keep=units)
    out = _finished(df, state, ids, columns)
    return out if g.keys else out.drop("_all")


def _sum_grams(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Element-wise sum of two tables of Gram arrays (few rows each)."""
    both = a.select(*keys, F.col("_base").alias("_gram")).unionByName(b.select(*keys, F.col("_more").alias("_gram")))
    return both.groupBy(*keys).agg(F.array(*[F.sum(F.col("_gram")[i]) for i in range(width)]).alias("_gram"))


def _ridge_udf(target: int, width: int) -> Callable:
    """Coefficients (intercept first) of column ``target`` on the other columns."""

    @F.pandas_udf("array<double>")
    def solve(grams: pd.Series) -> pd.Series:
        full = G.square(G.stack(grams, width))
        p = full.shape[1]
        order = [i for i in range(p) if i != target + 1] + [target + 1]
        return pd.Series(list(G.ridge(full[:, order][:, :, order], PENALTY, True)))

    return solve


# -- other estimators -----------------------------------------------------------------------------------------------


def tree_estimator(randomised: bool = False, seed: int = 0) -> Estimator:
    """A regression tree on all columns, or one that draws columns per split."""
    common = {"featuresCol": "_features", "labelCol": "_label", "predictionCol": "_predicted", "seed": seed}
    if randomised:
        return RandomForestRegressor(
            numTrees=1, featureSubsetStrategy="sqrt", bootstrap=False, maxDepth=10, **common
        )
    return DecisionTreeRegressor(maxDepth=10, **common)


def impute_chain_trees(
    df: DataFrame,
    columns: Sequence[str],
    is_train: Column | None = None,
    rounds: int = 2,
    randomised: bool = False,
) -> DataFrame:
    """I5, I6 on a whole table with MLlib trees: each incomplete column is predicted from the others, in rounds."""
    train = F.lit(True) if is_train is None else is_train
    means = df.agg(*[F.avg(F.when(train, F.col(c))).alias(c) for c in columns]).first()
    gaps = {c: f"_gap_{c}" for c in columns}
    state = df.withColumns({gaps[c]: F.col(c).isNull() for c in columns}).fillna({c: means[c] or 0.0 for c in columns})
    flags = state.agg(*[F.max(gaps[c]).alias(c) for c in columns]).first()
    for _ in range(rounds):
        state = cut(state)
        for c in (c for c in columns if flags[c]):
            others = [o for o in columns if o != c]
            described = VectorAssembler(inputCols=others, outputCol="_features").transform(state).withColumn(
                "_label", F.col(c)
            )
            model = tree_estimator(randomised).fit(described.where(train & ~F.col(gaps[c])))
            state = (
                model.transform(described)
                .withColumn(c, F.when(F.col(gaps[c]), F.col("_predicted")).otherwise(F.col(c)))
                .drop("_features", "_label", "_predicted")
            )
    return state.drop(*gaps.values())


def impute_chain_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    row_id: Sequence[str],
    is_train: Column | None = None,
    rounds: int = 2,
    k: int = 5,
    group_rows: int = BLOCK,
) -> DataFrame:
    """I5 with 5 nearest neighbours on the other columns as the estimator.

    Groups of up to ``group_rows`` rows go their rounds in one task; larger ones write the rows before every search."""
    train = F.lit(True) if is_train is None else is_train
    g = Grouping.of(df, keys, group_rows)
    cold, hot = g.split(df)
    parts = []
    if cold is not None:
        parts.append(_neighbour_chain_in_tasks(cold, g.keys, columns, row_id, train, rounds, k))
    if hot is not None:
        parts.append(_neighbour_chain_in_rounds(hot, Grouping.of(hot, keys, BLOCK), columns, row_id, train, rounds, k))
    return reduce(DataFrame.unionByName, parts)


def neighbour_chain(x: np.ndarray, train: np.ndarray, ids: np.ndarray, rounds: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The chain on the rows of one group, which stand in the order of their ``ids``; the row each result row comes from, and
    its values. As in a join on the row id, all rows of one id take what was found for any of them."""
    gaps, at = np.isnan(x), np.arange(len(x))
    seen = np.where(train[:, None], x, np.nan)
    n = (~np.isnan(seen)).sum(axis=0)
    out = np.where(gaps, np.where(n > 0, np.nansum(seen, axis=0) / np.maximum(n, 1), np.nan), x)
    for _ in range(rounds):
        for j in range(x.shape[1]):
            asked = np.flatnonzero(gaps[at, j])
            if not len(asked):
                continue
            others = np.delete(out, j, axis=1)
            donors = np.flatnonzero(train[at] & ~gaps[at, j])
            # equally near donors follow the order of missing pattern, first coordinate and row id
            pattern = np.isnan(others[donors]) @ (1 << np.arange(others.shape[1]))
            first = np.where(np.isnan(others[donors, 0]), -np.inf, others[donors, 0])
            donors = donors[np.lexsort((donors, first, pattern))]
            near = nearest_means(others[asked], others[donors], out[donors, j], k)
            if len(np.unique(ids[at])) == len(at):
                out[asked, j] = np.where(np.isnan(near), out[asked, j], near)
                continue
            found = [np.flatnonzero(ids[at[asked]] == i) for i in ids[at]]
            copies = np.repeat(np.arange(len(at)), [max(1, len(f)) for f in found])
            near = np.concatenate([near[f] if len(f) else [np.nan] for f in found])
            out, at = out[copies], at[copies]
            out[:, j] = np.where(np.isnan(near), out[:, j], near)
    return at, out


def _neighbour_chain_in_tasks(df: DataFrame, keys: Sequence[str], columns: Sequence[str], row_id: Sequence[str], train: Column, rounds: int, k: int) -> DataFrame:
    columns = list(columns)
    df = df.withColumn("_train", F.coalesce(train, F.lit(False))).withColumns({c: F.col(c).cast("double") for c in columns})

    def fill(rows: pa.Table, ends: np.ndarray) -> pa.Table:
        owner = pa.array(np.repeat(np.arange(len(ends) - 1), np.diff(ends)))
        by = rows.select(list(row_id)).append_column("_owner", owner)
        order = pc.sort_indices(by, [("_owner", "ascending"), *[(c, "ascending") for c in row_id]], null_placement="at_start")
        rows, by = rows.take(order), by.take(order)
        same = np.ones(max(0, len(rows) - 1), bool)
        for c in by.columns:
            a, b = c.slice(0, len(c) - 1), c.slice(1)
            both_null = pc.and_(pc.is_null(a), pc.is_null(b))
            same &= pc.or_(pc.fill_null(pc.equal(a, b), False), both_null).to_numpy()
        ids = np.cumsum(np.r_[0, ~same])
        x = np.column_stack([rows.column(c).to_numpy() for c in columns]).astype(float)
        fit = rows.column("_train").to_numpy().astype(bool)
        found = [neighbour_chain(x[a:b], fit[a:b], ids[a:b], rounds, k) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        rows = rows.take(pa.array(np.concatenate([at + a for (at, _), a in zip(found, ends[:-1], strict=True)])))
        out = np.concatenate([values for _, values in found])
        for i, c in enumerate(columns):
            rows = rows.set_column(rows.schema.get_field_index(c), c, pa.array(out[:, i], from_pandas=True))
        return rows

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return groups_together(df, keys, fill, types).drop("_train")


def _neighbour_chain_in_rounds(df: DataFrame, g: Grouping, columns: Sequence[str], row_id: Sequence[str], train: Column, rounds: int, k: int) -> DataFrame:
    ids = [*g.keys, *row_id]
    gaps = {c: f"_gap_{c}" for c in columns}
    base = g.with_stats(df, {f"_mean_{c}": st.mean(c).only(train) for c in columns})
    state = base.withColumns({gaps[c]: F.col(c).isNull() for c in columns})
    state = state.withColumns({c: F.coalesce(F.col(c), F.col(f"_mean_{c}")) for c in columns}).drop(
        *[f"_mean_{c}" for c in columns]
    )
    for _ in range(rounds):
        for c in columns:
            state = cut(state)
            others = [o for o in columns if o != c]
            asked = state.where(F.col(gaps[c])).withColumn(c, F.lit(None).cast("double"))
            found = nearest(g, asked, state.where(train & ~F.col(gaps[c])), others, [c], row_id, k)
            mean = F.aggregate("_found", F.lit(0.0), lambda t, f: t + f["v"]) / F.nullif(F.size("_found"), F.lit(0))
            state = join_on(state, found.select(*ids, mean.alias("_near")), ids, "left")
            state = state.withColumn(c, F.coalesce(F.col("_near"), F.col(c))).drop("_near")
    return state.drop(*gaps.values())


# -- expectation maximisation ---------------------------------------------------------------------------------------


def impute_em(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    row_id: Sequence[str],
    is_train: Column | None = None,
    rounds: int = EM_ROUNDS,
    tolerance: float = EM_TOLERANCE,
) -> DataFrame:
    """I7. Conditional means under a Gaussian per group, fitted by expectation maximisation on the training rows.

    A group is done when no mean or mean product of its standardised columns moves by more than ``tolerance`` in a round,
    and is left out of later rounds; after ``rounds`` rounds the last fit is taken.

    A round sums products of the completed incomplete rows plus their conditional covariances and adds the sums of
    the complete rows, which are taken once.
    """
    train = F.lit(True) if is_train is None else is_train
    marked, keys_ = _shared(df.withColumn("_train", F.coalesce(train, F.lit(False))), keys)
    g = Grouping.of(marked, keys_)
    d, ids = len(columns), [*keys_, *row_id]
    z = [f"_z{i}" for i in range(d)]
    width = (d + 1) * (d + 2) // 2
    table = _standardised(marked, g, columns)
    complete = cut(G.gram(table.where(F.col("_train") & ~any_null(z)), keys_, z, "_base"))
    rows = cut(
        table.where(any_null(z)).select(
            *ids, "_train", *[f"_{n}{i}" for n in ("m", "s") for i in range(d)], F.array(*z).alias("_row")
        )
    )
    expect = _expectation_udf(d)
    # independent standard columns to begin with
    start = np.zeros((d + 1, d + 1))
    start[range(d + 1), range(d + 1)] = 1.0
    first = F.array(*[F.lit(float(v)) for v in start[np.triu_indices(d + 1)]])
    model = rows.select(*keys_).distinct().withColumn("_gram", first)
    settled = None
    for _ in range(rounds):
        done = g.attach(rows, model).where(F.col("_gram").isNotNull()).withColumn("_e", expect("_row", "_gram"))
        sums = done.where("_train").groupBy(*keys_).agg(
            F.array(*[F.sum(F.col("_e.sums")[i]) for i in range(width)]).alias("_more")
        )
        fitted = join_on(model.withColumnRenamed("_gram", "_old"), _sum_grams(complete, sums, keys_, width), keys_, "left")
        moved = F.array_max(F.transform(F.arrays_zip("_gram", "_old"), lambda e: F.abs(e["_gram"] / F.col("_gram")[0] - e["_old"] / F.col("_old")[0])))
        # groups without a training row keep what they began with
        model = cut(
            fitted.select(*keys_, F.coalesce("_gram", "_old").alias("_gram"), F.coalesce(moved > tolerance, F.lit(False)).alias("_moving"))
        )
        still = model.where(~F.col("_moving")).drop("_moving")
        settled = still if settled is None else settled.unionByName(still)
        model = model.where("_moving").drop("_moving")
        if model.isEmpty():
            break
    done = g.attach(rows, model if settled is None else settled.unionByName(model)).withColumn("_e", expect("_row", "_gram"))
    state = done.select(*ids, *[f"_{n}{i}" for n in ("m", "s") for i in range(d)], *[F.col("_e.filled")[i].alias(z[i]) for i in range(d)])
    out = _finished(marked, state, ids, columns).drop("_train")
    return out if keys else out.drop("_all")


def _expectation_udf(d: int) -> Callable:
    """Completed row and its expected product sums under the Gaussian described by a Gram array."""
    upper = np.triu_indices(d + 1)

    @F.pandas_udf("filled array<double>, sums array<double>")
    def expect(rows: pd.Series, grams: pd.Series) -> pd.DataFrame:
        x = np.stack([np.array(r, dtype=float) for r in rows])
        full = G.square(G.stack(grams, len(upper[0])))
        n = np.maximum(full[:, 0, 0], 1e-12)
        mean = full[:, 0, 1:] / n[:, None]
        cov = full[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        cov = cov + 1e-6 * np.eye(d)
        filled = x.copy()
        extra = np.zeros((len(x), d + 1, d + 1))
        missing = np.isnan(x)
        for pattern in np.unique(missing, axis=0):
            at = np.flatnonzero((missing == pattern).all(axis=1))
            m, o = np.flatnonzero(pattern), np.flatnonzero(~pattern)
            s_mm = cov[np.ix_(at, m, m)]
            if len(o):
                s_mo, s_oo = cov[np.ix_(at, m, o)], cov[np.ix_(at, o, o)]
                weights = np.linalg.solve(s_oo, s_mo.transpose(0, 2, 1)).transpose(0, 2, 1)
                shift = (weights @ (x[np.ix_(at, o)] - mean[np.ix_(at, o)])[:, :, None])[:, :, 0]
                s_mm = s_mm - weights @ s_mo.transpose(0, 2, 1)
            else:
                shift = 0.0
            filled[np.ix_(at, m)] = mean[np.ix_(at, m)] + shift
            extra[np.ix_(at, m + 1, m + 1)] = s_mm
        one = np.column_stack([np.ones(len(x)), filled])
        sums = one[:, :, None] * one[:, None, :] + extra
        return pd.DataFrame({"filled": list(filled), "sums": list(sums[:, upper[0], upper[1]])})

    return expect
