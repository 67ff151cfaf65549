"""Regression trees for every group at once, chained filling with them, and boosted trees.

Trees grow level by level on binned features. For large groups a level is one job over all groups: counts and sums per
(group, node, feature, bin), added up before the shuffle, give the best split of every node, and each row carries the
number of its node. A group that fits a task grows its trees there, by the same rule on the same bins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.functions.columns import random_order
from cleanloom.operators.forest import tree_hashes
from cleanloom.plans import stats as st
from cleanloom.plans.grouping import Grouping, groups_together
from cleanloom.plans.ordered import join_on
from cleanloom.session import cut_in_loop as cut

# cut points of a feature: all values of groups of up to so many rows, else equally filled bins
BINS = 256
# nodes are numbered as in a heap, which a long holds down to this depth
DEEPEST = 60
# a split must explain this share of its node's squares; scores are whole multiples of it, so sums taken in another order agree
GAIN_UNIT = 1e-9
# nodes of a level that are sent to every task (some 60 bytes each); beyond, rows and nodes are shuffled
FEW_NODES = 100_000
# levels between two cuts of the rows
LEVELS_AT_ONCE = 2
# rounds of a chain of trees at most: their steps often go round in circles and never come within the tolerance
TREE_ROUNDS = 20
# rows of one group that one task may hold as a matrix
GROUP_ROWS = 200_000
# targets beyond this size are fitted apart from those of other groups
HUGE = 1e100
# fixed values: the boosted regressor's usual step and penalty, and the size, depth and share of rows asked for
RATE, LEAF_PENALTY = 0.3, 1.0
BOOSTED_TREES, BOOSTED_DEPTH, BOOSTED_SHARE = 500, 15, 0.9


@dataclass(frozen=True)
class Growth:
    """How far trees grow: depth, rows of a node that is split, rows of a child, penalty on leaf values."""

    depth: int = DEEPEST
    min_split: int = 2
    min_leaf: int = 1
    penalty: float = 0.0


# -- within a task --------------------------------------------------------------------------------------------------


def cut_values(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cut points of ``bins`` equally filled bins, as the statistic ``cuts`` has them."""
    x = np.sort(x[~np.isnan(x)])
    step = max(1, round(len(x) / bins))
    return x[np.arange(step - 1, len(x) - 1, step)]


def codes_of(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The bin of each value: how many cut points lie below it."""
    return np.searchsorted(cuts, x, side="left")


def split_scores(nl, sl, n, s, q, growth: Growth):
    """What splits of nodes with enough rows explain of their squares, in units; 0 where they may not be made."""
    nr, sr = n - nl, s - sl
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        gain = sl * sl / (nl + growth.penalty) + sr * sr / (nr + growth.penalty) - s * s / (n + growth.penalty)
        share = gain / np.maximum(q - s * s / n, 1e-300)
    if growth.min_leaf > 1:
        share[(nl < growth.min_leaf) | (nr < growth.min_leaf)] = 0.0
    share[~(share > 0)] = 0.0
    return np.floor(np.minimum(share, 1e6) / GAIN_UNIT + 0.5)


def grow_tree(codes: np.ndarray, y: np.ndarray, fit: np.ndarray, growth: Growth) -> np.ndarray:
    """The leaf value of every row of a tree grown from the rows where ``fit`` holds.

    Of equally good splits the first feature and the lowest cut win.
    """
    return grow_together(np.ascontiguousarray(codes.T), y, fit, np.zeros(len(y), np.int64), growth)


def grow_together(
    codes: np.ndarray, y: np.ndarray, fit: np.ndarray, root: np.ndarray, growth: Growth, asked: np.ndarray | None = None,
    order: np.ndarray | None = None, alone: bool = False,
) -> np.ndarray:
    """:func:`grow_tree` for the trees of several groups at once: ``root`` numbers the group of each row from 0.

    ``codes`` has a row per feature. Only values of ``asked`` rows are worked out (all when not given), and only nodes that
    hold some are split further. ``order``, all rows of each feature by group and code, may be given where it is known.
    With ``alone`` sums are taken in the order in which a tree grown by itself and in whole takes them: where cuts are
    equally good but for rounding, the same one is chosen whatever other groups and asked rows there are.
    """
    d, n = codes.shape
    value, node = np.zeros(n), root.astype(np.int64)
    if not fit.any():
        return value
    if order is None:
        order = in_code_order(codes, root)
    # all features one after the other: rows of feature f stand at f * size to (f + 1) * size
    order = order.ravel()[fit.take(order.ravel())]
    ask = np.arange(n) if asked is None else np.flatnonzero(asked)
    flat, least = codes.ravel(), max(growth.min_split, 2 * growth.min_leaf, 2)
    m = int(root.max()) + 1
    inside, group = np.flatnonzero(fit), np.arange(m)
    for depth in range(growth.depth + 1):
        size = len(order) // d
        at = node.take(order[:size])
        count = np.bincount(at, minlength=m)
        own = y.take(order[:size])
        first = np.cumsum(count) - count
        if alone:
            s, q = (np.bincount(node.take(inside), v, m) for v in (y.take(inside), y.take(inside) ** 2))
        elif depth:  # every node below the roots has rows
            s, q = np.add.reduceat(own, first), np.add.reduceat(own * own, first)
        else:
            s, q = np.zeros(m), np.zeros(m)
            some = np.flatnonzero(count)
            s[some], q[some] = np.add.reduceat(own, first[some]), np.add.reduceat(own * own, first[some])
        place = node.take(ask)
        value[ask] = (s / (np.maximum(count, 1e-300) + growth.penalty)).take(place)
        if depth == growth.depth:
            break
        # nodes that are split further hold enough rows and a row whose value is asked for
        wanted = np.zeros(m, bool)
        wanted[place] = True
        wanted &= count >= least
        if alone:
            wanted[:] = True
        stays = wanted.take(at)
        kept = int(np.count_nonzero(stays))
        if not kept:
            break
        if kept < size:
            order = order[wanted.take(node.take(order))]
            at, count, size = at[stays], np.where(wanted, count, 0), kept
            first = np.cumsum(count) - count
        ends = np.empty(size, bool)
        ends[:-1], ends[-1] = at[1:] != at[:-1], True
        code = flat.take(order.reshape(d, size) + np.arange(0, d * n, n)[:, None])
        edges = np.empty((d, size), bool)
        np.not_equal(code[:, 1:], code[:, :-1], out=edges[:, :-1])
        edges[:, ends] = False
        edge = np.flatnonzero(edges.ravel())
        if not len(edge):
            break
        f = np.repeat(np.arange(d), np.count_nonzero(edges, axis=1))
        spot = edge - f * size
        which = at.take(spot)
        cell = which + f * m
        if alone:
            # node by node, and within a node feature by feature; each group begins at zero
            begins = d * first + np.arange(d)[:, None] * count
            spots = begins.take(at, axis=1) + (np.arange(size) - first.take(at))
            sums = np.empty(d * size)
            sums[spots.ravel()] = y.take(order)
            ends_at = d * np.r_[first[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])], size]
            for a, b in zip(ends_at[:-1], ends_at[1:], strict=True):
                np.cumsum(sums[a:b], out=sums[a:b])
            left = sums.take(spots.ravel().take(edge))
            start = begins.ravel().take(cell)
            left -= np.where(start == (d * first)[np.searchsorted(group, group)].take(which), 0.0, sums.take(start - 1))
        else:
            sums = np.cumsum(y.take(order).reshape(d, size), axis=1)
            before = np.zeros((d, m))
            later = first > 0
            before[:, later] = sums.take(first[later] - 1, axis=1)
            left = sums.ravel().take(edge) - before.ravel().take(cell)
        score = split_scores(spot + 1 - first.take(which), left, count.take(which), s.take(which), q.take(which), growth)
        if alone and least > 2:
            score[count.take(which) < least] = 0.0
        # the best score of each node; its first edge in the order of features and cuts
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        highest = np.zeros(d * m)
        highest[cell[starts]] = np.maximum.reduceat(score, starts)
        best = highest.reshape(d, m).max(axis=0)
        best[best <= 0] = -1
        hit = np.flatnonzero(score == best.take(which))[::-1]
        if not len(hit):
            break
        chosen = np.full(m, -1)
        chosen[which.take(hit)] = hit  # the last one written is the first edge
        split = np.flatnonzero(chosen >= 0)
        feature, border = np.zeros(m, np.int64), np.zeros(m, codes.dtype)
        feature[split], border[split] = f.take(chosen[split]) * n, code.ravel().take(edge.take(chosen[split]))
        child = np.full(m, -1)
        child[split] = 2 * np.arange(len(split))
        goes = child >= 0
        ask = ask[goes.take(place)]
        if len(split) < np.count_nonzero(wanted):
            order = order[goes.take(node.take(order))]
        size = len(order) // d
        if alone:
            inside = inside[goes.take(node.take(inside))]
            group = np.repeat(group[split], 2)
        live = ask if asked is None else np.concatenate([ask, order[:size]])
        old = node.take(live)
        node[live] = child.take(old) + (flat.take(feature.take(old) + live) > border.take(old))
        m = 2 * len(split)
        order = order.reshape(d, size)
        turn = stable_order(node.take(order), m) + np.arange(0, d * size, size)[:, None]
        order = order.ravel().take(turn.ravel())
    return value


def stable_order(numbers: np.ndarray, below: int) -> np.ndarray:
    """Positions along the last axis by rising number, equal ones in their order; short numbers sort in linear time."""
    return np.argsort(numbers.astype(np.uint16) if below <= 1 << 16 else numbers, axis=-1, kind="stable")


def in_code_order(codes: np.ndarray, root: np.ndarray) -> np.ndarray:
    """All rows by group and code, for each feature."""
    order = stable_order(codes, int(codes.max(initial=0)) + 1)
    return np.take_along_axis(order, stable_order(root[order], int(root.max(initial=0)) + 1), axis=1)


def chain_with_trees(z: np.ndarray, train: np.ndarray, rounds: int, tolerance: float, growth: Growth = Growth(), bins: int = BINS) -> np.ndarray:  # noqa: B008
    """Fill a standardised (n, d) matrix: start at the mean, then a tree on the others predicts each incomplete column.

    Trees are grown from training rows that have the column. It ends when a round moves no cell by more than
    ``tolerance`` times the largest value of the incomplete rows at the start.
    """
    return chains_with_trees(z, train, np.array([0, len(z)]), rounds, tolerance, growth, bins)


def chains_with_trees(
    z: np.ndarray, train: np.ndarray, ends: np.ndarray, rounds: int, tolerance: float, growth: Growth = Growth(), bins: int = BINS  # noqa: B008
) -> np.ndarray:
    """:func:`chain_with_trees` of several groups, whose rows lie between ``ends``; their trees grow together.

    A round is a function of the cells filled so far. So a column is not fitted again while no cell of the others has
    changed its bin, and a group that comes back to the cells of an earlier round goes round in that circle to the end.
    """
    n, d = z.shape
    missing = np.isnan(z)
    out = np.where(missing, 0.0, z)
    groups = len(ends) - 1
    owner = np.repeat(np.arange(groups), np.diff(ends))
    cuts = [[cut_values(np.where(train[a:b], z[a:b, j], np.nan), bins) for j in range(d)] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    codes = np.zeros((d, n), np.int32)
    for g, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        for j in range(d):
            codes[j, a:b] = codes_of(out[a:b, j], cuts[g][j])
    some = missing.any(axis=1)
    largest = np.zeros(groups)
    np.maximum.at(largest, owner[some], np.abs(out[some]).max(axis=1, initial=0.0))
    fits = train[:, None] & ~missing
    # columns that are filled in each group
    todo = np.zeros((groups, d), bool)
    seen = np.zeros((groups, d), bool)
    for j in range(d):
        todo[owner[missing[:, j]], j] = True
        seen[owner[fits[:, j]], j] = True
    todo &= seen
    stale = todo.copy()
    going = todo.any(axis=1)
    gaps = [np.flatnonzero(some[a:b]) + a for a, b in zip(ends[:-1], ends[1:], strict=True)]
    past: list[list[np.ndarray]] = [[] for _ in range(groups)]
    met: list[dict[bytes, int]] = [{} for _ in range(groups)]
    for done in range(1, rounds + 1):
        if not going.any():
            break
        change = np.zeros(groups)
        for j in range(d):
            picked = going & stale[:, j]
            if not picked.any():
                continue
            stale[:, j] &= ~picked
            rows = np.flatnonzero(picked[owner])
            root = (np.cumsum(picked) - 1)[owner[rows]]
            gap = missing[rows, j]
            others = np.delete(np.arange(d), j)
            found = grow_together(codes[np.ix_(others, rows)], out[rows, j], fits[rows, j], root, growth, gap, alone=True)[gap]
            cells = rows[gap]
            np.maximum.at(change, owner[cells], np.abs(found - out[cells, j]))
            out[cells, j] = found
            edges = np.flatnonzero(np.r_[True, owner[cells][1:] != owner[cells][:-1], True])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                g = owner[cells[a]]
                now = codes_of(found[a:b], cuts[g][j])
                if (now != codes[j, cells[a:b]]).any():
                    codes[j, cells[a:b]] = now
                    stale[g, np.arange(d) != j] |= todo[g, np.arange(d) != j]
        going &= change > tolerance * largest
        if done < rounds:
            for g in np.flatnonzero(going):
                cells = out[gaps[g]]
                at = met[g].setdefault(cells.tobytes(), len(past[g]))
                if at < len(past[g]):
                    out[gaps[g]] = past[g][at + (rounds - done) % (len(past[g]) - at)]
                    going[g] = False
                else:
                    past[g].append(cells)
    return out


def boosted(
    codes: np.ndarray, y: np.ndarray, train: np.ndarray, rows: np.ndarray, trees: int, growth: Growth, rate: float, share: float
) -> np.ndarray:
    """Predictions of all rows by trees that are grown one after the other on what the trees before leave over."""
    return boosted_together(np.ascontiguousarray(codes.T), y, train, rows, np.array([0, len(y)]), trees, growth, rate, share)


def boosted_together(
    codes: np.ndarray, y: np.ndarray, train: np.ndarray, rows: np.ndarray, ends: np.ndarray, trees: int, growth: Growth, rate: float, share: float
) -> np.ndarray:
    """:func:`boosted` for several groups, whose rows lie between ``ends``; ``codes`` has a row per feature.

    Groups are brought to one size by powers of two, which changes no digit, as their sums are taken together.
    """
    groups = len(ends) - 1
    owner = np.repeat(np.arange(groups), np.diff(ends))
    fitted = np.bincount(owner[train], minlength=groups) > 0
    out, unit = np.full(len(y), np.nan), np.ones(groups)
    for g in np.flatnonzero(fitted):
        own = slice(ends[g], ends[g + 1])
        seen = y[own][train[own]]
        if groups > 1 and np.abs(seen).max() > HUGE:
            # its sums may overflow, which is kept from the others
            out[own] = boosted_together(codes[:, own], y[own], train[own], rows[own], np.array([0, len(y[own])]), trees, growth, rate, share)
            fitted[g] = False
            continue
        out[own] = seen.mean()
        unit[g] = 2.0 ** np.frexp(np.abs(seen - out[ends[g]]).max())[1] if np.abs(seen).max() <= HUGE else 1.0
    own = np.flatnonzero(fitted[owner])
    if not len(own):
        return out
    unit = unit[owner[own]]
    codes, y, train, rows, made = codes[:, own], y[own] / unit, train[own], rows[own], out[own] / unit
    root = (np.cumsum(fitted) - 1)[owner[own]]
    order = in_code_order(codes, root)
    for tree in range(trees):
        made += rate * grow_together(codes, y - made, train & drawn(rows, tree, share), root, growth, order=order)
    out[own] = made * unit
    return out


def drawn(rows: np.ndarray, tree: int, share: float) -> np.ndarray:
    """The rows a tree is grown from, by a hash of row and tree."""
    return (tree_hashes(rows, tree) >> np.uint64(11)).astype(np.float64) < share * 2.0**53


# -- across tasks ---------------------------------------------------------------------------------------------------


def best_splits(rows: DataFrame, by: Sequence[str], growth: Growth) -> DataFrame:
    """by, _node, _leaf (value), _feature, _border (null for a leaf) of every node of ``rows`` (by, _node, _codes, _y, _fit)."""
    cells = rows.where("_fit").select(*by, "_node", "_y", F.posexplode("_codes").alias("_f", "_b"))
    keys = [*by, "_node"]
    sums = cells.groupBy(*keys, "_f", "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_s"), F.sum(F.col("_y") * F.col("_y")).alias("_q")
    )
    feature = Window.partitionBy(*keys, "_f")
    upto = feature.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = sums.select(
        *keys, "_f", "_b", F.sum("_n").over(upto).alias("nl"), F.sum("_s").over(upto).alias("sl"),
        F.sum("_n").over(feature).alias("n"), F.sum("_s").over(feature).alias("s"), F.sum("_q").over(feature).alias("q"),
    )
    lam = F.lit(float(growth.penalty))
    nr, sr = F.col("n") - F.col("nl"), F.col("s") - F.col("sl")
    gain = F.col("sl") * F.col("sl") / (F.col("nl") + lam) + sr * sr / F.nullif(nr + lam, F.lit(0.0)) - F.col("s") * F.col("s") / (F.col("n") + lam)
    share = gain / F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(1e-300))
    fits = (F.col("nl") >= growth.min_leaf) & (nr >= growth.min_leaf) & (F.col("n") >= growth.min_split) & (nr > 0)
    score = F.when(fits, F.floor(F.least(F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0)), F.lit(1e6)) / GAIN_UNIT + 0.5)).otherwise(0)
    best = F.max(F.struct(score.cast("long").alias("score"), (-F.col("_f")).alias("f"), (-F.col("_b")).alias("b")))
    found = h.groupBy(*keys).agg(best.alias("_best"), F.max(F.struct("n", "s")).alias("_all"))
    split = F.col("_best.score") > 0
    return found.select(
        *keys, (F.col("_all.s") / (F.col("_all.n") + lam)).alias("_leaf"), F.when(split, -F.col("_best.f")).alias("_feature"), F.when(split, -F.col("_best.b")).alias("_border")
    )


def grow_trees(rows: DataFrame, by: Sequence[str], growth: Growth) -> DataFrame:
    """Add ``_value``, the leaf value of every row, to ``rows`` (by, _codes, _y, _fit): a tree for each group, a level at a time."""
    # written first: plans over columns that stand for each other take long to optimise
    state = cut(rows.withColumns({"_node": F.lit(1).cast("long"), "_open": F.lit(True), "_value": F.lit(0.0)}))
    for depth in range(growth.depth + 1):
        found = cut(best_splits(state.where("_open"), by, growth))
        nodes, splits = found.agg(F.count(F.lit(1)), F.count("_feature")).first()
        met = join_on(state, found, [*by, "_node"], "left", small=nodes <= FEW_NODES)
        open_ = F.col("_open") & F.col("_leaf").isNotNull()
        goes = open_ & F.col("_feature").isNotNull()
        right = F.when(F.try_element_at("_codes", F.col("_feature") + 1) > F.col("_border"), 1).otherwise(0)
        state = met.withColumns({
            "_value": F.when(open_, F.col("_leaf")).otherwise(F.col("_value")),
            "_node": F.when(goes, F.col("_node") * 2 + right).otherwise(F.col("_node")),
            "_open": F.coalesce(goes, F.lit(False)),
        }).drop("_leaf", "_feature", "_border")
        if depth == growth.depth or not splits:
            break
        if (depth + 1) % LEVELS_AT_ONCE == 0:
            state = cut(state)
    return cut(state.drop("_node", "_open"))


def code_column(x: str | Column, cuts: str) -> Column:
    """The bin of a value, as :func:`codes_of` has it."""
    x = F.col(x) if isinstance(x, str) else x
    return F.size(F.filter(cuts, lambda c: c < x))


def split_by_size(df: DataFrame, keys: Sequence[str] | Grouping, group_rows: int) -> tuple[Grouping, DataFrame | None, DataFrame | None]:
    """The grouping with the rows of groups that fit a task and those of larger ones."""
    known = isinstance(keys, Grouping) and keys.is_bounded
    g = keys if known else Grouping.of(df, keys.keys if isinstance(keys, Grouping) else keys, group_rows)
    return g, *g.split(df)


def chain_trees_in_rounds(
    table: DataFrame, keys: Sequence[str], ids: Sequence[str], d: int, rounds: int, tolerance: float, growth: Growth = Growth(), bins: int = BINS,  # noqa: B008
    keep: Sequence[str] = (),
) -> DataFrame:
    """The rounds of :func:`chain_with_trees` for groups that no task holds; a level of the trees of all groups is one job.

    ``table``: keys, row columns, _train, _z<i>. Returns ids, ``keep`` and the filled _z<i> of all rows.
    """
    own = Grouping(keys, table.select(*keys).distinct(), False, GROUP_ROWS)
    z = [f"_z{i}" for i in range(d)]
    cuts = {f"_cut{i}": st.cuts(c, bins).only(F.col("_train")) for i, c in enumerate(z)}
    # written step by step, so that no plan holds many names of one column: the optimiser would relate them all to each other
    binned = cut(own.with_stats(cut(table.select(*ids, "_train", *keep, *z)), cuts))
    gaps = {f"_gap{i}": F.col(c).isNull() for i, c in enumerate(z)}
    state = cut(binned.withColumns(gaps)).withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in z})
    state = cut(state.withColumns({f"_code{i}": code_column(c, f"_cut{i}") for i, c in enumerate(z)}).withColumn("_done", F.lit(False)))
    some = F.greatest(*[F.col(f"_gap{i}") for i in range(d)]) if d > 1 else F.col("_gap0")
    size = F.greatest(*[F.abs(F.col(c)) for c in z]) if d > 1 else F.abs(F.col("_z0"))
    largest = cut(state.where(some).groupBy(*keys).agg(F.max(size).alias("_largest")))
    holes = state.agg(*[F.max(f"_gap{i}").alias(f"_gap{i}") for i in range(d)]).first()
    for _ in range(rounds):
        state = cut(state.withColumns({f"_old{i}": F.col(c) for i, c in enumerate(z)}))
        for j in (j for j in range(d) if holes[f"_gap{j}"]):
            shaped = state.withColumns({
                "_codes": F.array(*[F.col(f"_code{i}") for i in range(d) if i != j]), "_y": F.col(f"_z{j}"),
                "_fit": F.col("_train") & ~F.col(f"_gap{j}") & ~F.col("_done"),
            })
            grown = grow_trees(shaped, keys, growth)
            new = F.col(f"_gap{j}") & ~F.col("_done")
            state = grown.withColumn(f"_z{j}", F.when(new, F.col("_value")).otherwise(F.col(f"_z{j}"))).withColumn(
                f"_code{j}", F.when(new, code_column("_value", f"_cut{j}")).otherwise(F.col(f"_code{j}"))
            ).drop("_codes", "_y", "_fit", "_value")
        state = cut(state)
        change = reduce(lambda a, b: F.greatest(a, b), [F.abs(F.col(c) - F.col(f"_old{i}")) for i, c in enumerate(z)], F.lit(0.0))
        moved = join_on(state.groupBy(*keys).agg(F.max(change).alias("_change")), largest, keys, "left", small=True)
        still = cut(moved.select(*keys, (F.col("_change") <= tolerance * F.coalesce("_largest", F.lit(0.0))).alias("_still")))
        state = state.drop(*[f"_old{i}" for i in range(d)])
        if still.where(~F.col("_still")).isEmpty():
            break
        state = cut(join_on(state, still, keys, "left", small=True).withColumn("_done", F.col("_done") | F.coalesce("_still", F.lit(True))).drop("_still"))
    return state.select(*ids, *keep, *z)


def boost(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    features: Sequence[str],
    target: str,
    row_id: Sequence[str],
    is_train: Column,
    trees: int = BOOSTED_TREES,
    depth: int = BOOSTED_DEPTH,
    share: float = BOOSTED_SHARE,
    rate: float = RATE,
    penalty: float = LEAF_PENALTY,
    bins: int = BINS,
    seed: int = 0,
    group_rows: int = GROUP_ROWS,
    out: str = "prediction",
) -> DataFrame:
    """M5. Add the predictions of a boosted regressor per key, fitted on the training rows that have a target.

    Squared loss; each tree is grown from a ``share`` of the rows, on what the trees before leave over. Missing feature
    values lie below all others. Groups of up to ``group_rows`` rows are fitted in a task each; the trees of all larger
    groups grow together, one job a level. Groups without such rows get no prediction.
    """
    growth = Growth(depth, 2, 1, penalty)
    names = [f"_x{i}" for i in range(len(features))]
    marked = df.withColumns({
        **{n: F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))) for n, c in zip(names, features, strict=True)},
        "_y": F.col(target).cast("double"), "_row": random_order(row_id, seed, "boost"),
    }).withColumn("_fit", F.coalesce(is_train, F.lit(False)) & F.col("_y").isNotNull())
    g, cold, hot = split_by_size(marked, keys, group_rows)
    extra = [*names, "_y", "_row", "_fit"]
    parts = []
    if cold is not None:
        parts.append(_boost_in_tasks(cold, g.keys, names, trees, growth, rate, share, bins, out))
    if hot is not None:
        parts.append(_boost_in_rounds(hot, g.keys, names, trees, growth, rate, share, bins, out))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.drop(*extra)


def _boost_in_tasks(df: DataFrame, keys, names, trees, growth, rate, share, bins, out) -> DataFrame:
    def fit(rows: pa.Table, ends: np.ndarray) -> pa.Table:
        x = [rows.column(c).to_numpy() for c in names]
        y, train = rows.column("_y").to_numpy().astype(float), rows.column("_fit").to_numpy().astype(bool)
        codes = np.zeros((len(x), len(y)), np.int32)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            for i, c in enumerate(x):
                codes[i, a:b] = codes_of(c[a:b], cut_values(np.where(train[a:b], c[a:b], np.nan), bins))
        found = boosted_together(codes, np.nan_to_num(y), train, rows.column("_row").to_numpy(), ends, trees, growth, rate, share)
        return rows.append_column(out, pa.array(found, from_pandas=True))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return groups_together(df, keys, fit, f"{schema}, `{out}` double")


def _boost_in_rounds(df: DataFrame, keys, names, trees, growth, rate, share, bins, out) -> DataFrame:
    by = list(keys) or ["_all"]
    df = df if keys else df.withColumn("_all", F.lit(0))
    own = Grouping(by, df.select(*by).distinct(), False, GROUP_ROWS)
    binned = own.with_stats(df, {f"_cut{i}": st.cuts(c, bins).only(F.col("_fit")) for i, c in enumerate(names)} | {out: st.mean("_y").only(F.col("_fit"))})
    codes = F.array(*[code_column(c, f"_cut{i}") for i, c in enumerate(names)])
    state = cut(binned.withColumn("_codes", codes).withColumnsRenamed({"_y": "_label", "_fit": "_trained"}).drop(*[f"_cut{i}" for i in range(len(names))]))
    for tree in range(trees):
        shaped = state.withColumns({"_y": F.coalesce(F.col("_label") - F.col(out), F.lit(0.0)), "_fit": F.col("_trained") & _drawn_udf(tree, share)("_row")})
        grown = grow_trees(shaped, by, growth)
        state = grown.withColumn(out, F.col(out) + rate * F.col("_value")).drop("_y", "_fit", "_value")
    state = state.drop("_codes").withColumnsRenamed({"_label": "_y", "_trained": "_fit"})
    return state if keys else state.drop("_all")


def _drawn_udf(tree: int, share: float) -> Callable:
    @F.pandas_udf("boolean")
    def draw(rows: pd.Series) -> pd.Series:
        return pd.Series(drawn(rows.to_numpy(), tree, share))

    return draw
