"""Isolation forests on single columns (O2)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.columns import random_order
from cleanloom.operators.impute import fill_stat, stat_value
from cleanloom.plans import stats as st
from cleanloom.plans.grouping import Grouping, grouping, groups_together
from cleanloom.session import cut

# fixed values: the forest's usual size, and the score above which a value counts as an outlier
TREES = 100
SAMPLE = 256
SCORE_LIMIT = 0.5
# a tree's sample is looked for among about so many times its size, those of smallest hash
SPARE = 3
# hashes held in memory at once
CELLS = 1_000_000


def _average_depth(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n values."""
    n = np.asarray(n, dtype=float)
    big = 2 * (np.log(np.maximum(n, 2) - 1) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def grown_leaves(positions: np.ndarray, pool: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """The leaves of all trees, level by level: tree, place in the order of values, upper bound, path length.

    ``positions`` (trees, sample): where the values of each tree stand in the sorted ``pool``, in rising order. A node is a run
    of these; it is cut at a random value between its smallest and its largest.
    """
    trees, size = positions.shape
    far = len(pool) + 1
    flat = (positions + np.arange(trees)[:, None] * far).ravel()  # rising over all trees
    tree = np.arange(trees)
    start, end, upper = tree * size, (tree + 1) * size, np.full(trees, np.inf)
    leaves: list[tuple[np.ndarray, ...]] = []
    for depth in range(limit + 1):
        low, high = pool[flat[start] - tree * far], pool[flat[end - 1] - tree * far]
        closed = (low == high) | (end - start <= 1) if depth < limit else np.ones(len(tree), bool)
        leaves.append((tree[closed], start[closed], upper[closed], depth + _average_depth((end - start)[closed])))
        tree, start, end, upper, low, high = (x[~closed] for x in (tree, start, end, upper, low, high))
        if not len(tree):
            break
        at = low + (high - low) * rng.random(len(tree))
        middle = np.searchsorted(flat, tree * far + np.searchsorted(pool, at, side="right"), side="left")
        middle = np.clip(middle, start + 1, end - 1)
        tree, start, end, upper = np.r_[tree, tree], np.r_[start, middle], np.r_[middle, end], np.r_[at, upper]
    return tuple(np.concatenate(x) for x in zip(*leaves, strict=True))


def tree_hashes(rows: np.ndarray, tree: int) -> np.ndarray:
    """A random number per row and tree, from a 64-bit hash of the row."""
    return hashes_of_trees(rows, range(tree, tree + 1))[0]


def hashes_of_trees(rows: np.ndarray, trees: range) -> np.ndarray:
    """:func:`tree_hashes` of several trees, a row for each."""
    x = rows.astype(np.uint64) + np.array([(t + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for t in trees], np.uint64)[:, None]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def wanted_by_trees(rows: np.ndarray, n: np.ndarray, trees: int = TREES, sample: int = SAMPLE) -> np.ndarray:
    """Rows that may be in the sample of some tree, where ``n`` rows of the group have a value.

    A tree takes the rows of smallest hash; SPARE times as many as it needs lie below the limit on average, and fewer
    than it needs with a chance below 1e-50.
    """
    share = np.minimum(1.0, SPARE * sample / np.maximum(n, 1))
    limit = np.minimum(share * 2.0**64, 2.0**64 - 2048).astype(np.uint64)
    wanted = share >= 1
    for tree in range(trees):
        wanted |= tree_hashes(rows, tree) <= limit
    return wanted


def outlier_bounds(
    pool: np.ndarray, rows: np.ndarray, seed: int, trees: int = TREES, sample: int = SAMPLE
) -> tuple[bool, list[float]]:
    """Whether values below the first bound are outliers, and the bounds at which that changes.

    ``rows`` are hashes of the rows that hold the values; the sample of a tree is the rows of its smallest hashes.
    """
    rng = np.random.default_rng(seed)
    by = np.lexsort((rows, pool))
    pool, rows = pool[by], rows[by]
    size = min(sample, len(pool))
    limit = int(np.ceil(np.log2(max(size, 2))))
    chosen = np.tile(np.arange(size), (trees, 1))
    if size < len(pool):
        step = max(1, CELLS // len(pool))
        for start in range(0, trees, step):
            some = range(start, min(start + step, trees))
            least = np.argpartition(hashes_of_trees(rows, some), size - 1, axis=1)[:, :size]
            chosen[some.start : some.stop] = np.sort(least, axis=1)
    tree, place, upper, path = grown_leaves(chosen, pool, limit, rng)
    order = np.lexsort((place, tree))
    tree, upper, path = tree[order], upper[order], path[order]
    # the summed path length is a step function: it starts with the first leaf of each tree and changes behind upper bounds
    inner = np.flatnonzero(tree[1:] == tree[:-1])
    edges, at = np.unique(np.r_[upper[inner], np.inf], return_inverse=True)
    change = np.bincount(at[:-1], path[inner + 1] - path[inner], len(edges))
    depth = path[np.r_[True, tree[1:] != tree[:-1]]].sum() + np.r_[0.0, np.cumsum(change)[:-1]]
    unit = max(float(_average_depth(size)), 1e-12)
    flagged = 2 ** (-(depth / trees) / unit) > SCORE_LIMIT
    changes = np.flatnonzero(flagged[1:] != flagged[:-1])
    return bool(flagged[0]), [float(edges[i]) for i in changes]


def _bounds_below(bounds: Column, x: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b < x))


def flag_with_forest(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    columns: Sequence[str],
    row_id: Sequence[str],
    is_train: Column,
    seed: int = 42,
) -> DataFrame:
    """Add ``_out<i>`` per column: whether a forest of the training rows isolates the value early.

    The forest of a column is a step function of the value, so it ends as a few bounds per group; scoring is a
    column expression. Every training row with a value can be in the sample of every tree. Only rows that some tree
    may take are shuffled: TREES * SPARE * SAMPLE per group and column on average, however large the group.
    """
    g = grouping(df, keys)
    counted = g.with_stats(df.where(is_train), {f"_n{i}": st.count(c) for i, c in enumerate(columns)})
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v"), F.col(f"_n{i}").alias("_n"))
            for i, c in enumerate(columns)
        ]
    )
    rows = counted.select(*g.keys, random_order(row_id, seed, "forest").alias("_row"), F.inline(cells))
    rows = rows.where(F.col("_v").isNotNull())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted_by_trees(batch.column("_row").to_numpy(), batch.column("_n").to_numpy())))

    pool = rows.mapInArrow(keep, rows.schema)
    by = [*g.keys, "_c"]
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pool.schema if f.name in by)

    def fit(table: pa.Table, ends: np.ndarray) -> pa.Table:
        values, names = table.column("_v").to_numpy().astype(float), table.column("_row").to_numpy()
        found = [outlier_bounds(values[a:b], names[a:b], seed) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        cells = [table.column(k).take(pa.array(ends[:-1])) for k in by]
        cells += [pa.array([first for first, _ in found], pa.bool_()), pa.array([bounds for _, bounds in found], pa.list_(pa.float64()))]
        return pa.Table.from_arrays(cells, names=[*by, "_first", "_bounds"])

    fitted = groups_together(pool, by, fit, f"{key_types}, _first boolean, _bounds array<double>")
    wide = fitted.groupBy(*g.keys).agg(
        *[F.max(F.when(F.col("_c") == i, F.struct("_first", "_bounds"))).alias(f"_f{i}") for i in range(len(columns))]
    )
    # forests are costly to grow, so they are written once
    out = g.attach(df, cut(wide))
    flags = {}
    for i, c in enumerate(columns):
        passed = _bounds_below(F.col(f"_f{i}._bounds"), F.col(c)) % 2 == 1
        flags[f"_out{i}"] = F.coalesce(passed != F.col(f"_f{i}._first"), F.lit(False)) & F.col(c).isNotNull()
    return out.withColumns(flags).drop(*[f"_f{i}" for i in range(len(columns))])


def repair_with_forest(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    columns: Sequence[str],
    repair: str,
    row_id: Sequence[str],
    is_train: Column,
    seed: int = 42,
) -> DataFrame:
    """O2. Values that a forest of the training rows isolates early get a training statistic, in all splits."""
    g = grouping(df, keys)
    out = repair_flagged(flag_with_forest(df, g, columns, row_id, is_train, seed), g, {c: c for c in columns}, repair, is_train)
    return out.drop(*[f"_out{i}" for i in range(len(columns))])


def repair_flagged(df: DataFrame, g: Grouping, columns: Mapping[str, str], repair: str, is_train: Column) -> DataFrame:
    """Add ``{new column: source}`` with the i-th source's flagged values (``_out<i>``) replaced by a training statistic."""
    out = g.with_stats(df, {f"_fix{i}": fill_stat(repair, c).only(is_train) for i, c in enumerate(columns.values())})
    repaired = {
        new: F.when(F.col(f"_out{i}"), stat_value(repair, f"_fix{i}")).otherwise(F.col(c)) for i, (new, c) in enumerate(columns.items())
    }
    return out.withColumns(repaired).drop(*[f"_fix{i}" for i in range(len(columns))])
