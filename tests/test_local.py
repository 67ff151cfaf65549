"""Options within a task against the same options as column expressions, and searches on both paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleanloom.operators import local, options, search, space
from cleanloom.plans.grouping import Grouping


def series(spark):
    """Groups of several sizes: ties, a constant column, one without any value, one without training rows, twins."""
    rng = np.random.default_rng(2)
    rows = []
    for key, n in (("a", 60), (None, 41), ("flat", 12), ("gone", 9), ("untrained", 6), ("lone", 1)):
        x = np.column_stack([rng.integers(0, 8, n), np.round(rng.normal(size=n) * 9, 2), rng.integers(1, 40, n) * 100]).astype(float)
        y = np.round(x @ [1.5, 0.5, 0.01] + rng.normal(size=n), 2)
        if key == "flat":
            x[:, 0] = 3.0
        gaps = rng.random((n, 3)) < 0.15
        if key == "gone":
            gaps[:, 1] = True
        for i in range(n):
            split = "val" if key == "untrained" else ("train", "train", "train", "val", "test")[i % 5]
            rows.append((key, i, *[None if gaps[i, j] else float(x[i, j]) for j in range(3)], None if i == 7 else float(y[i]), split))
    rows += [(k, i + 1000, *rest) for k, i, *rest in rows if k == "a" and i < 20]
    return spark.createDataFrame(rows, "k string, id long, p double, q double, r double, y double, split string")


def test_options_within_a_task_are_the_column_expressions(spark):
    table = series(spark)
    steps = space.preparation_space()
    every = {f"{o.name}_{c}": (c, o) for s in steps for o in s.options for c in "pqr"}
    rows = sorted(options.run(table, Grouping.of(table, ["k"]), every, F.col("split") == "train").collect(), key=lambda r: (str(r["k"]), r["id"]))
    ends = np.flatnonzero([True, *[a["k"] != b["k"] for a, b in zip(rows, rows[1:])], True])
    groups = local.Groups(ends, np.array([r["split"] == "train" for r in rows]))
    column = lambda name: np.array([np.nan if r[name] is None else r[name] for r in rows], float)
    found = local.apply_chains({c: column(c) for c in "pqr"}, {}, groups, {n: (c, [o]) for n, (c, o) in every.items()})
    assert len(found) == len(every) and local.can_run({n: (c, [o]) for n, (c, o) in every.items()}, {})
    for name in every:
        assert np.allclose(found[name], column(name), rtol=1e-9, atol=1e-9, equal_nan=True), name


@pytest.mark.parametrize("target_as", ["value", "rank"])
def test_sums_are_the_same_in_tasks_and_distributed(spark, target_as):
    table = series(spark).where("k IS NULL OR k IN ('a', 'flat', 'gone')")
    steps = space.preparation_space(models=True)
    chains = [*search.fixed_chains(steps, ("missing_value_imputation", "normalization"))[::3], *search.flexible_chains(steps)[::7]]

    def solve(total):
        return {"sums": [float(v) for s in search.SPLITS for v in total[s].ravel()]}

    args = (["k"], ["p", "q", "r"], "y", chains, ["id"], solve, "sums array<double>", "split", target_as)
    small = search.solve_by_key(table, *args)
    # neither option columns nor their sums are shuffled
    assert "_x0_0" not in small._jdf.queryExecution().toString()
    got = {r["k"]: r["sums"] for r in small.collect()}
    large = {r["k"]: r["sums"] for r in search.solve_by_key(table, *args, group_rows=20).collect()}
    assert got.keys() == large.keys() == {"a", None, "flat", "gone"}
    for k, v in got.items():
        assert np.allclose(v, large[k], rtol=1e-7, atol=1e-7), k
    assert search.solve_by_key(table.limit(0), *args).count() == 0


def test_random_searches_are_the_same_in_tasks_and_distributed(spark):
    table = series(spark).where("k IN ('a', 'gone', 'untrained')")
    for per_feature in (False, True):
        options_ = {"seeds": 6, "per_feature": per_feature, "row_id": ["id"]}
        got, large = (
            {(r["k"], r["seed"]): [r[c] for c in ("best_val_loss", "best_tr_loss", "best_test_loss")] for r in search.random_search(table, ["k"], ["p", "q"], "y", **options_, **more).collect()}
            for more in ({}, {"group_rows": 2})
        )
        assert got.keys() == large.keys() and len(got) == 18
        for k, v in got.items():
            assert [x is None for x in v] == [x is None for x in large[k]]
            assert np.allclose(np.array(v, float), np.array(large[k], float), rtol=1e-6, equal_nan=True), (k, v, large[k])
    alone = table.where("k = 'a'")
    whole = search.random_search(alone, [], ["p", "q"], "y", seeds=3, row_id=["id"]).collect()
    assert [r["best_val_loss"] for r in sorted(whole, key=lambda r: r["seed"])] == pytest.approx([
        r["best_val_loss"] for r in sorted(search.random_search(alone, ["k"], ["p", "q"], "y", seeds=3, row_id=["id"]).collect(), key=lambda r: r["seed"])
    ])
