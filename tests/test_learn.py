"""Learned option probabilities: the gradient against differences, the losses against fits on the mixed rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleanloom.operators import learn as L
from cleanloom.operators.search import fixed_chains
from cleanloom.operators.space import preparation_space


@pytest.fixture(scope="module")
def moments():
    rng = np.random.default_rng(0)
    d, m, n = 3, 4, 120
    x = rng.normal(size=(n, d * m)) + np.repeat(rng.normal(size=(n, d)), m, axis=1)
    y = x[:, 1] - 0.5 * x[:, 6] + rng.normal(size=n) * 0.3 + 2
    train = np.arange(n) < 80
    z = np.column_stack([np.ones(n), x, y])
    grams = [z[part].T @ z[part] for part in (train, ~train)]
    means = grams[0][0, 1:] / grams[0][0, 0]
    return d, m, x, y, train, *[L.Sums.about(g, means) for g in grams]


def test_loss_is_that_of_a_ridge_fit_on_mixed_rows(moments):
    d, m, x, y, train, fit, val = moments
    logits = np.random.default_rng(1).normal(size=(d, m))
    mixed = np.einsum("nfo,fo->nf", x.reshape(-1, d, m), L.softmax(logits))
    mx, my = mixed[train].mean(0), y[train].mean()
    w = np.linalg.solve((mixed[train] - mx).T @ (mixed[train] - mx) + L.PENALTY * np.eye(d), (mixed[train] - mx).T @ (y[train] - my))
    want = np.mean((y[~train] - my - (mixed[~train] - mx) @ w) ** 2)
    assert abs(L.loss_and_gradient(logits, fit, val)[0] - want) < 1e-9


def test_gradient_equals_differences(moments):
    d, m, *_, fit, val = moments
    logits = np.random.default_rng(2).normal(size=(d, m))
    _, slope = L.loss_and_gradient(logits, fit, val)
    for f in range(d):
        for o in range(m):
            step = np.zeros((d, m))
            step[f, o] = 1e-6
            difference = (L.loss_and_gradient(logits + step, fit, val)[0] - L.loss_and_gradient(logits - step, fit, val)[0]) / 2e-6
            assert abs(difference - slope[f, o]) < 1e-6


def test_descent_never_rises(moments):
    d, m, *_, fit, val = moments
    logits, losses = L.descend(np.zeros((d, m)), fit, val)
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0]
    assert abs(L.loss_and_gradient(logits, fit, val)[0] - losses[-1]) < 1e-12


def test_probabilities_per_key(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key in ("a", None):
        for i in range(90):
            p, q = float(rng.normal()), float(rng.integers(0, 50))
            rows.append((key, i, p if i % 9 else None, q if i % 7 else None, 3 * p + q / 10, ("train", "train", "val", "test")[i % 4]))
    table = spark.createDataFrame(rows, "k string, i long, p double, q double, y double, split string")
    chains = fixed_chains(preparation_space(), ("missing_value_imputation", "normalization"))
    found = L.learn_probabilities(table, ["k"], ["p", "q"], "y", chains, ["i"], steps=30)
    got = found.collect()
    assert {r["k"] for r in got} == {"a", None}
    for r in got:
        assert r["best_val_loss"] <= r["start_val_loss"] == r["losses"][0] and r["losses"][-1] == r["best_val_loss"]
        assert all(abs(sum(p) - 1) < 1e-9 and len(p) == len(chains) for p in r["probabilities"])
        assert r["choices"] == [L.chain_name(chains[int(np.argmax(p))]) for p in r["probabilities"]]
    log = L.probability_log(found, ["k"], ["p", "q"], chains)
    assert log.count() == 2 * 2 * len(chains) and log.where("chosen").count() == 4
    assert abs(log.agg(F.sum("probability")).first()[0] - 4) < 1e-9
    assert L.learn_probabilities(table.limit(0), ["k"], ["p", "q"], "y", chains, ["i"]).count() == 0
