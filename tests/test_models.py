"""Linear models, chained filling and the sweep against direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleanloom.functions.columns import random_order
from cleanloom.operators import sweep as sweeps
from cleanloom.operators.forest import outlier_bounds
from cleanloom.operators.impute_chain import chain_matrix, impute_chain, impute_em
from cleanloom.operators.linear import ALPHAS, INTERCEPTS, TEST_PART, fit_linear
from cleanloom.plans import gram as G


def direct_ridge(x, y, alpha, intercept):
    mx, my = (x.mean(0), y.mean()) if intercept else (np.zeros(x.shape[1]), 0.0)
    w = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return w, my - mx @ w


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 3)) * [1, 50, 3] + [0, 900, 5]
    y = x @ [2.0, -0.1, 0.0] + rng.normal(size=90)
    part = np.where(np.arange(90) < 20, TEST_PART, (np.arange(90) - 20) // 14)
    rows = [(f"k{i % 1}", *map(float, x[i]), float(y[i]), int(part[i])) for i in range(90)]
    return x, y, part, spark.createDataFrame(rows, "k string, a double, b double, c double, y double, p int")


@pytest.mark.parametrize("dummies", [False, True])
def test_ridge_grid_equals_direct_solve(table, dummies):
    x, y, part, df = table
    got = fit_linear(df, ["k"], ["a", "b", "c"], "y", F.col("p"), date_dummies=dummies).first()
    train = part != TEST_PART
    zx = (x - x[train].mean(0)) / x[train].std(0)
    zy = (y - y[train].mean()) / y[train].std()
    best = None
    for alpha in ALPHAS:
        for intercept in INTERCEPTS:
            losses = []
            for f in range(5):
                fit, held = train & (part != f), part == f
                w, b = direct_ridge(zx[fit], zy[fit], alpha + dummies, intercept)
                losses.append(((zy[held] - zx[held] @ w - b) ** 2).mean())
            if best is None or np.mean(losses) < best[0] - 1e-13:
                best = (np.mean(losses), alpha, intercept)
    w, b = direct_ridge(zx[train], zy[train], best[1] + dummies, best[2])
    rmse = np.sqrt(((zy[~train] - zx[~train] @ w - b) ** 2).mean())
    assert (got["alpha"], got["fit_intercept"]) == best[1:]
    assert abs(got["cv_mse"] - best[0]) < 1e-9 and abs(got["test_rmse"] - rmse) < 1e-9


def test_date_dummies_act_as_one_more_unit_of_penalty():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(30, 2)), rng.normal(size=30)
    wide = np.column_stack([x, np.eye(30)])
    full, _ = direct_ridge(wide, y, 0.5, False)
    small, _ = direct_ridge(x, y, 1.5, False)
    assert np.allclose(full[:2], small)


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(50, 4)), rng.normal(size=50)
    z = np.column_stack([np.ones(50), x, y])
    w = G.lasso((z.T @ z)[None], 0.1, False)[0][1:]
    slope = x.T @ (y - x @ w) / 50
    assert np.all(np.abs(slope) <= 0.1 + 1e-6)
    assert np.allclose(slope[w != 0], 0.1 * np.sign(w[w != 0]), atol=1e-6)


@pytest.fixture(scope="module")
def gaps(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=120)
    x = np.column_stack([a, 2 * a + 0.01 * rng.normal(size=120), -a + 0.01 * rng.normal(size=120)])
    full = x.copy()
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = [
        ("u" if i % 2 else "v", i, *[None if np.isnan(c) else float(c) for c in x[i]], bool(i % 7)) for i in range(120)
    ]
    return full, x, spark.createDataFrame(rows, "k string, id long, a double, b double, c double, train boolean")


def matrix(df):
    return np.array([r[1:] for r in sorted(map(tuple, df.select("id", "a", "b", "c").collect()))], dtype=float)


def test_chain_in_rounds_equals_chain_in_tasks(gaps):
    full, x, df = gaps
    plain = matrix(impute_chain(df, ["k"], ["a", "b", "c"], ["id"], F.col("train")))
    for rounds in (1, 3):
        own, spread = (matrix(impute_chain(df, ["k"], ["a", "b", "c"], ["id"], F.col("train"), rounds, n)) for n in (10**6, 10))
        assert np.allclose(own, spread, rtol=0, atol=1e-9, equal_nan=True), rounds
    spread = matrix(impute_chain(df, ["k"], ["a", "b", "c"], ["id"], F.col("train"), group_rows=10))
    seen = ~np.isnan(x)
    assert np.array_equal(plain[seen], x[seen])
    alone = seen.sum(axis=1) > 0
    assert np.abs(plain - full)[alone].max() < 0.2
    assert np.abs(plain - spread)[alone].max() < 1e-9


def test_em_recovers_linear_relations(gaps):
    full, x, df = gaps
    out = matrix(impute_em(df, ["k"], ["a", "b", "c"], ["id"], F.col("train"), rounds=6))
    alone = (~np.isnan(x)).sum(axis=1) > 0
    assert np.abs(out - full)[alone].max() < 0.3


def test_sweep_methods_and_split(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key in ("p", "q"):
        a = rng.normal(size=150)
        rows += [(key, 0, i, float(a[i]), float(rng.normal()), float(3 * a[i] + 0.1 * rng.normal())) for i in range(150)]
    df = spark.createDataFrame(rows, "s string, part int, i long, a double, b double, y double")
    args = (["s", "part"], ["a", "b"], "y", ["i"], ["i"])
    out = sweeps.sweep(df, *args, drop_share=0.1).collect()
    assert {r["method"] for r in out} == set(sweeps.METHODS) and len(out) == 12
    assert all(r["n_test"] == 30 for r in out)
    assert all(r["n_train"] == (120 if r["method"] != "Noclean" else r["n_train"]) for r in out)
    assert all(96 <= r["n_train"] < 120 for r in out if r["method"] == "Noclean")
    again = sweeps.sweep(df.repartition(7), *args, drop_share=0.1).collect()
    key = lambda r: (r["s"], r["method"])
    for a, b in zip(sorted(out, key=key), sorted(again, key=key), strict=True):
        assert abs(a["rmse"] - b["rmse"]) < 1e-9
    # y is nearly a multiple of a, so every method predicts well
    assert max(r["rmse"] for r in out) < 0.5


def test_sweep_outliers_against_direct_computation(spark):
    rng = np.random.default_rng(6)
    n, names = 60, ["a", "b", "y"]
    x = rng.normal(size=(n, 2)) * [1, 3]
    x[::9] *= 6
    rows = [(0, i, *map(float, x[i]), float(2 * x[i, 0] - x[i, 1] + 0.3 * rng.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "part int, i long, a double, b double, y double")
    args = (["part"], ["a", "b"], "y", ["i"], ["i"])
    out = {r["method"]: r for r in sweeps.sweep_outliers(df, *args, drop_share=0.1).collect()}
    assert set(out) == {f"{m}_{d}_{r}" for m in ("mean", "median", "mode", "knn", "mice") for d in ("iqr", "zscore", "iforest") for r in ("mean", "median")}
    ready = sweeps.prepared(df, *args, drop_share=0.1)[0].orderBy("i").select(*names, "is_train", random_order(["i"], 42, "forest").alias("h")).collect()
    gappy = np.array([[np.nan if r[c] is None else r[c] for c in names] for r in ready])
    train, hashes = np.array([r["is_train"] for r in ready]), np.array([r["h"] for r in ready])
    assert np.isnan(gappy).sum() >= 6
    near = gappy.copy()
    for i, c in zip(*np.where(np.isnan(gappy)), strict=True):
        both = ~np.isnan(gappy) & ~np.isnan(gappy[i])
        gap = np.where(both, gappy - gappy[i], 0.0) ** 2
        far = gap.sum(1) * 3 / np.maximum(both.sum(1), 1)
        donors = np.flatnonzero(train & ~np.isnan(gappy[:, c]) & both.any(1))
        near[i, c] = gappy[donors[np.argsort(far[donors], kind="stable")[:5]], c].mean()
    mean, spread = np.nanmean(gappy[train], 0), np.nanstd(gappy[train], 0)
    chained = np.where(np.isnan(gappy), chain_matrix((gappy - mean) / spread, train) * spread + mean, gappy)
    for imputer, filled in (("knn", near), ("mice", chained)):
        for detector in ("zscore", "iforest"):
            for repair, fix in (("mean", np.mean), ("median", np.median)):
                z = filled.copy()
                for c in (0, 1):
                    v = filled[:, c]
                    if detector == "zscore":
                        m, s = (np.where(train, f(v[train]), f(v[~train])) for f in (np.mean, np.std))
                        bad = np.abs(v - m) > 0.5 * s
                    else:
                        first, bounds = outlier_bounds(v[train], hashes[train], 42)
                        bad = first ^ ((np.array(bounds)[None, :] < v[:, None]).sum(1) % 2 == 1)
                    z[bad, c] = fix(v[train])
                z = (z - z[train].mean(0)) / np.where(z[train].std(0) > 0, z[train].std(0), 1.0)
                got = out[f"{imputer}_{detector}_{repair}"]
                w, b = direct_ridge(z[train, :2], z[train, 2], got["alpha"], got["fit_intercept"])
                want = np.sqrt(((z[~train, 2] - z[~train, :2] @ w - b) ** 2).mean())
                assert abs(got["rmse"] - want) < 1e-8, (imputer, detector, repair)


def plain_em(x, train, tolerance, rounds):
    """Filled rows and the number of rounds, a row at a time."""
    seen = np.where(train[:, None], x, np.nan)
    m, s = np.nanmean(seen, axis=0), np.nanstd(seen, axis=0)
    z, d = (x - m) / s, x.shape[1]
    mean, product = np.zeros(d), np.eye(d)

    def expect():
        cov = product - np.outer(mean, mean) + 1e-6 * np.eye(d)
        filled, extra = z.copy(), np.zeros((len(z), d, d))
        for i, row in enumerate(z):
            u, o = np.flatnonzero(np.isnan(row)), np.flatnonzero(~np.isnan(row))
            w = cov[np.ix_(u, o)] @ np.linalg.inv(cov[np.ix_(o, o)])
            filled[i, u] = mean[u] + w @ (row[o] - mean[o])
            extra[i][np.ix_(u, u)] = cov[np.ix_(u, u)] - w @ cov[np.ix_(o, u)]
        return filled, extra

    for used in range(1, rounds + 1):
        filled, extra = expect()
        old = np.concatenate([mean, product.ravel()])
        mean = filled[train].mean(axis=0)
        product = (filled[:, :, None] * filled[:, None, :] + extra)[train].mean(axis=0)
        if np.abs(np.concatenate([mean, product.ravel()]) - old).max() <= tolerance:
            break
    return expect()[0] * s + m, used


def test_em_stops_by_group_as_a_plain_version(spark):
    rng = np.random.default_rng(9)
    groups, rows = {}, [("none", 1000, 1.0, None, 2.0, False)]
    for k, share in (("close", 0.02), ("loose", 0.5)):
        x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3))
        x[rng.random(x.shape) < share] = np.nan
        x[np.isnan(x).all(axis=1)] = 0.5
        groups[k] = x
        rows += [(k, i, *[None if np.isnan(c) else float(c) for c in r], bool(i % 5)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, id long, a double, b double, c double, train boolean")
    out = impute_em(df, ["k"], ["a", "b", "c"], ["id"], F.col("train"), rounds=8, tolerance=0.02)
    used = set()
    for k, x in groups.items():
        want, n = plain_em(x, np.arange(60) % 5 > 0, 0.02, 8)
        used.add(n)
        assert np.allclose(matrix(out.where(F.col("k") == k)), want, atol=1e-7)
    assert len(used) == 2
    assert out.where("k = 'none'").select("a", "c").first() == (1.0, 2.0) and out.count() == 121


def test_samples_of_trees_are_drawn_together(monkeypatch):
    from cleanloom.operators import forest

    rng = np.random.default_rng(8)
    values, rows = rng.integers(0, 60, 700) / 4, rng.integers(0, 1 << 52, 700)
    whole = forest.outlier_bounds(values, rows, 5)
    calls, hashes = [], forest.hashes_of_trees
    monkeypatch.setattr(forest, "hashes_of_trees", lambda r, trees: calls.append(len(trees)) or hashes(r, trees))
    assert forest.outlier_bounds(values, rows, 5) == whole and calls == [forest.TREES]
    monkeypatch.setattr(forest, "CELLS", 3 * 700)
    assert forest.outlier_bounds(values, rows, 5) == whole and max(calls[1:]) == 3
    assert all(np.array_equal(hashes(rows, range(9))[t], forest.tree_hashes(rows, t)) for t in range(9))
