"""Grouped regression trees, chained filling with them and boosted trees against plain versions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cleanloom.operators import trees as T
from cleanloom.operators.impute_chain import impute_chain


def plain_tree(x, y, fit, depth=60, penalty=0.0, min_leaf=1):
    """Leaf values by trying every feature and observed value of a node, one node after the other."""
    out = np.zeros(len(y))
    todo = [(np.arange(len(y)), 0)]
    while todo:
        rows, level = todo.pop()
        own = rows[fit[rows]]
        n, s, q = len(own), y[own].sum(), (y[own] ** 2).sum()
        out[rows] = s / (n + penalty)
        best = (0, None)
        if level < depth and n >= 2:
            for f in range(x.shape[1]):
                for v in np.unique(x[own, f])[:-1]:
                    left = own[x[own, f] <= v]
                    right = own[x[own, f] > v]
                    if min(len(left), len(right)) < min_leaf:
                        continue
                    gain = y[left].sum() ** 2 / (len(left) + penalty) + y[right].sum() ** 2 / (len(right) + penalty) - s * s / (n + penalty)
                    score = int(np.floor(max(0.0, gain / max(q - s * s / n, 1e-300)) / 1e-9 + 0.5))
                    if score > best[0]:
                        best = (score, (f, v))
        if best[1]:
            f, v = best[1]
            todo += [(rows[x[rows, f] <= v], level + 1), (rows[x[rows, f] > v], level + 1)]
    return out


def codes(x, fit):
    return np.column_stack([T.codes_of(c, T.cut_values(np.where(fit, c, np.nan))) for c in x.T])


@pytest.mark.parametrize("seed", range(6))
def test_tree_equals_a_plain_one(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, [3, 40, 1000], (120, 3)).astype(float)
    y = np.round(x @ [2.0, -0.5, 0.01] + rng.normal(size=120) * (seed % 2), 3)
    fit = rng.random(120) < 0.8
    for growth in (T.Growth(), T.Growth(depth=3), T.Growth(depth=4, penalty=1.0), T.Growth(min_leaf=5)):
        got = T.grow_tree(codes(x, fit), y, fit, growth)
        assert np.allclose(got, plain_tree(x, y, fit, growth.depth, growth.penalty, growth.min_leaf))
    assert not T.grow_tree(codes(x, fit), y, np.zeros(120, bool), T.Growth()).any()


def test_trees_of_all_groups_grow_a_level_at_a_time(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for key in ("a", "b", None):
        n = 60
        x, fit = rng.integers(0, 12, (n, 2)), rng.random(n) < 0.8
        y = np.round(x @ [1.0, -2.0] + rng.normal(size=n), 3)
        for growth in (T.Growth(depth=3),):
            for i, v in enumerate(T.grow_tree(x, y, fit, growth)):
                want[key, i] = v
        rows += [(key, i, x[i].tolist(), float(y[i]), bool(fit[i])) for i in range(n)]
    table = spark.createDataFrame(rows, "k string, i long, _codes array<int>, _y double, _fit boolean")
    got = {(r["k"], r["i"]): r["_value"] for r in T.grow_trees(table, ["k"], T.Growth(depth=3)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for key in ("a", "b", None, "lone"):
        n = 1 if key == "lone" else 50
        x = rng.integers(0, 30, (n, 3)).astype(float)
        x[:, 2] = x[:, 0] * 2 - x[:, 1]
        gone = rng.random((n, 3)) < 0.1
        rows += [(key, i, *[None if gone[i, j] else float(x[i, j]) for j in range(3)], i % 5 != 0) for i in range(n)]
    return spark.createDataFrame(rows, "k string, i long, p double, q double, r double, is_train boolean")


def test_chained_trees_are_the_same_in_tasks_and_in_rounds(spark, gappy):
    args = (["k"], ["p", "q", "r"], ["i"], F.col("is_train"))
    key = lambda r: (str(r["k"]), r["i"])
    options = {"rounds": 2, "estimator": "tree", "growth": T.Growth(depth=2)}
    small = sorted(impute_chain(gappy, *args, **options).collect(), key=key)
    large = sorted(impute_chain(gappy, *args, group_rows=10, **options).collect(), key=key)
    before = sorted(gappy.collect(), key=key)
    assert len(small) == len(before) == len(large)
    for a, b, was in zip(small, large, before, strict=True):
        for c in "pqr":
            assert a[c] is not None and abs(a[c] - b[c]) < 1e-6 and (was[c] is None or was[c] == a[c])
    assert impute_chain(gappy.limit(0), *args, estimator="tree").count() == 0
    with pytest.raises(ValueError):
        impute_chain(gappy, *args, estimator="oak")


def test_chained_trees_follow_plain_rounds(gappy):
    rows = [r for r in gappy.collect() if r["k"] == "a"]
    x = np.array([[np.nan if r[c] is None else r[c] for c in "pqr"] for r in rows])
    train, missing = np.array([r["is_train"] for r in rows]), np.isnan(x)
    z = (x - np.nanmean(x[train], axis=0)) / np.nanstd(x[train], axis=0)
    want = np.where(missing, 0.0, z)
    for _ in range(2):
        for j in range(3):
            others = [i for i in range(3) if i != j]
            # bins come from the observed values, so plain splits see the value at the top of each bin
            seen = np.column_stack([T.codes_of(want[:, i], T.cut_values(np.where(train, z[:, i], np.nan))) for i in others])
            want[missing[:, j], j] = plain_tree(seen, want[:, j], train & ~missing[:, j])[missing[:, j]]
    assert np.allclose(T.chain_with_trees(z, train, 2, 0.0), want)


def boosting_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for key in ("a", None):
        x = rng.integers(0, 20, (80, 3)).astype(float)
        y = np.sin(x[:, 0]) * 3 + x[:, 1] * x[:, 2] / 50
        rows += [(key, i, *map(float, x[i]), None if i % 17 == 0 else float(round(y[i], 4)), i % 4 != 0) for i in range(80)]
    rows += [("none", i, 1.0, 2.0, None, None, True) for i in range(3)]
    return spark.createDataFrame(rows, "k string, i long, p double, q double, r double, y double, is_train boolean")


def test_boosting_is_the_same_in_tasks_and_in_rounds(spark):
    table = boosting_rows(spark)
    args = (["k"], ["p", "q", "r"], "y", ["i"], F.col("is_train"))
    options = {"trees": 2, "depth": 2, "share": 0.9}
    small = {(r["k"], r["i"]): r["prediction"] for r in T.boost(table, *args, **options).collect()}
    large = {(r["k"], r["i"]): r["prediction"] for r in T.boost(table, *args, group_rows=2, **options).collect()}
    assert small.keys() == large.keys() and len(small) == table.count()
    for k, v in small.items():
        assert (v is None) == (large[k] is None) == (k[0] == "none") and (v is None or abs(v - large[k]) < 1e-9)
    assert T.boost(table.limit(0), *args, **options).count() == 0


def test_boosting_follows_plain_rounds_and_learns(spark):
    table = boosting_rows(spark).where("k = 'a'")
    rows = sorted(table.withColumn("row", T.random_order(["i"], 0, "boost")).collect(), key=lambda r: r["i"])
    x = np.array([[r["p"], r["q"], r["r"]] for r in rows])
    y = np.array([np.nan if r["y"] is None else r["y"] for r in rows])
    train, names = np.array([r["is_train"] for r in rows]) & ~np.isnan(y), np.array([r["row"] for r in rows])
    want = np.full(len(y), y[train].mean())
    for t in range(4):
        want += 0.3 * plain_tree(x, np.nan_to_num(y) - want, train & T.drawn(names, t, 0.9), 5, 1.0)
    got = {r["i"]: r["prediction"] for r in T.boost(table, [], ["p", "q", "r"], "y", ["i"], F.col("is_train"), trees=4, depth=5).collect()}
    assert np.allclose([got[r["i"]] for r in rows], want)
    whole = {r["i"]: r["prediction"] for r in T.boost(table, [], ["p", "q", "r"], "y", ["i"], F.col("is_train")).collect()}
    error = lambda p: float(np.sqrt(np.mean([(p[r["i"]] - r["y"]) ** 2 for r in rows if r["y"] is not None and not r["is_train"]])))
    assert error(whole) < 0.8 * np.nanstd(y)


def test_trees_of_small_groups_grow_in_one_go(monkeypatch):
    rng = np.random.default_rng(11)
    sizes = [1, 40, 7, 90, 3]
    ends, n = np.r_[0, np.cumsum(sizes)], sum(sizes)
    x = rng.integers(0, [9, 30, 4], (n, 3)).astype(float)
    y, train, names = np.round(x @ [3.0, 1.0, -2.0] + rng.normal(size=n), 2), rng.random(n) < 0.8, rng.integers(0, 1 << 50, n)
    y[ends[1] : ends[2]] *= 1e12  # one group of large values takes no digits from the others
    train[0], train[ends[2] : ends[3]] = True, False
    parts = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    own = np.concatenate([codes(x[p], train[p]) for p in parts])
    growth = T.Growth(6, 2, 1, 1.0)
    calls, grow = [], T.grow_together
    monkeypatch.setattr(T, "grow_together", lambda *a, **k: calls.append(1) or grow(*a, **k))
    got = T.boosted_together(np.ascontiguousarray(own.T), y, train, names, ends, 8, growth, 0.3, 0.9)
    assert len(calls) == 8
    monkeypatch.undo()
    for p in parts:
        if not train[p].any():
            assert np.isnan(got[p]).all()
            continue
        want = np.full(len(y[p]), y[p][train[p]].mean())
        for t in range(8):
            want += 0.3 * plain_tree(own[p], y[p] - want, train[p] & T.drawn(names[p], t, 0.9), 6, 1.0)
        assert np.allclose(got[p], want)


def test_only_asked_values_are_worked_out():
    rng = np.random.default_rng(12)
    x, y, fit = rng.integers(0, 50, (300, 3)), rng.normal(size=300), rng.random(300) < 0.9
    asked = np.zeros(300, bool)
    asked[[3, 77, 150]] = True
    root = np.zeros(300, np.int64)
    whole = T.grow_tree(x, y, fit, T.Growth())
    some = T.grow_together(np.ascontiguousarray(x.T), y, fit, root, T.Growth(), asked)
    assert np.array_equal(whole[asked], some[asked]) and not some[~asked].any()


def test_chains_of_several_groups_are_those_of_each():
    rng = np.random.default_rng(13)
    sizes = [1, 60, 2, 45, 30]
    ends, n = np.r_[0, np.cumsum(sizes)], sum(sizes)
    z = np.round(rng.normal(size=(n, 4)), 2)
    z[:, 3] = z[:, 0] - z[:, 1]
    z[rng.random((n, 4)) < 0.1] = np.nan
    z[ends[2] : ends[3]] = np.nan
    train = rng.random(n) < 0.8
    got = T.chains_with_trees(z, train, ends, 12, 1e-3)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        # bit by bit: sums are taken in the order in which a group by itself takes them
        assert np.array_equal(got[a:b], T.chain_with_trees(z[a:b], train[a:b], 12, 1e-3))
        missing = np.isnan(z[a:b])
        want = np.where(missing, 0.0, z[a:b])
        cuts = [T.cut_values(np.where(train[a:b], z[a:b, j], np.nan)) for j in range(4)]
        largest = np.abs(want[missing.any(axis=1)]).max(initial=0.0)
        for _ in range(12):
            change = 0.0
            for j in np.flatnonzero(missing.any(axis=0) & (train[a:b, None] & ~missing).any(axis=0)):
                seen = np.column_stack([T.codes_of(want[:, i], cuts[i]) for i in range(4) if i != j])
                new = plain_tree(seen, want[:, j], train[a:b] & ~missing[:, j])[missing[:, j]]
                change = max(change, np.abs(new - want[missing[:, j], j]).max())
                want[missing[:, j], j] = new
            if change <= 1e-3 * largest:
                break
        assert np.allclose(got[a:b], want)


def test_small_groups_reach_a_task_together_and_whole(spark):
    from cleanloom.plans.grouping import groups_together

    table = spark.createDataFrame([(k, i) for k in ("a", None, "b", "c") for i in range(4)] + [("lone", 0)], "k string, v long").coalesce(1)

    def work(rows, ends):
        parts = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        keys, values = rows.column("k").to_pylist(), rows.column("v").to_pylist()
        assert all(len(set(keys[p])) == 1 and len(set(values[p])) == len(values[p]) for p in parts)
        return rows.append_column("n", pa.array(np.repeat(np.diff(ends), np.diff(ends)))).append_column("calls", pa.array([len(parts)] * len(rows)))

    out = groups_together(table, ["k"], work, "k string, v long, n long, calls long").collect()
    assert len(out) == 17 and all(r["n"] == (1 if r["k"] == "lone" else 4) for r in out)
    assert groups_together(table.limit(0), ["k"], work, "k string, v long, n long, calls long").count() == 0
