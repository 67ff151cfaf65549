"""The blocked search must agree with the single-task search and with plain numpy."""

import random

import numpy as np
from pyspark.sql import functions as F

from cleanloom.operators.impute_knn import impute_knn, knn_classify
from cleanloom.plans import nearest as nearest_plan


def make(spark, n=100):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        key = "big" if i % 4 else "small"
        cells = [None if rnd.random() < 0.15 else float(rnd.randrange(40)) for _ in range(3)]
        rows.append((key, i, *cells, rnd.random() < 0.8, float(rnd.randrange(3))))
    return rows, spark.createDataFrame(rows, "key string, id long, a double, b double, c double, train boolean, y double")


def values(df):
    return sorted(map(tuple, df.select("key", "id", "a", "b", "c").collect()))


def test_blocked_equals_plain(spark, monkeypatch):
    _, df = make(spark)
    plain = values(impute_knn(df, ["key"], ["a", "b", "c"], ["id"], F.col("train")))
    monkeypatch.setattr(nearest_plan, "BLOCK", 11)
    spread = values(impute_knn(df, ["key"], ["a", "b", "c"], ["id"], F.col("train"), block=40))
    assert plain == spread
    assert not any(v is None for row in plain for v in row)


def test_plain_equals_numpy(spark):
    rows, df = make(spark, 60)
    got = {(r[0], r[1]): r[2:] for r in values(impute_knn(df, ["key"], ["a", "b", "c"], ["id"], F.col("train"), k=3))}
    for key in ("big", "small"):
        part = [r for r in rows if r[0] == key]
        x = np.array([[np.nan if v is None else v for v in r[2:5]] for r in part])
        for i, r in enumerate(part):
            for c in range(3):
                if r[2 + c] is not None:
                    assert got[key, r[1]][c] == r[2 + c]
                    continue
                pool = []
                for j, s in enumerate(part):
                    both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                    if s[5] and s[2 + c] is not None and both.any():
                        d = 3 / both.sum() * ((x[i] - x[j])[both] ** 2).sum()
                        pattern = sum(1 << b for b in range(3) if s[2 + b] is None)
                        pool.append((round(d, 9), pattern, -1 if s[2] is None else s[2], s[1], s[2 + c]))
                want = [p[4] for p in sorted(pool)[:3]]
                if want:
                    assert abs(got[key, r[1]][c] - np.mean(want)) < 1e-9


def test_classify_blocked_equals_plain(spark, monkeypatch):
    _, df = make(spark)
    df = df.fillna(0.0)
    plain = sorted(map(tuple, knn_classify(df, [], ["a", "b"], "y", ["id"], F.col("train")).collect()))
    monkeypatch.setattr(nearest_plan, "BLOCK", 13)
    spread = sorted(map(tuple, knn_classify(df, [], ["a", "b"], "y", ["id"], F.col("train"), block=30).collect()))
    assert plain == spread and len(plain) > 10


def test_chains_of_neighbours_are_the_same_in_tasks_and_in_rounds(spark, monkeypatch):
    from cleanloom.operators import impute_chain as chain

    cuts, cut = [], chain.cut
    monkeypatch.setattr(chain, "cut", lambda df: cuts.append(1) or cut(df))
    rng = np.random.default_rng(5)
    rows = []
    for key, n in (("a", 40), (None, 25), ("gone", 8), ("lone", 1)):
        x = rng.integers(0, 12, (n, 3)).astype(float)
        gone = rng.random((n, 3)) < 0.2
        if key == "gone":
            gone[:, 2] = True
        rows += [(key, i % 7, i, *[None if gone[i, j] else float(x[i, j]) for j in range(3)], None if i == 3 else i % 5 != 0) for i in range(n)]
    rows += [r for r in rows if r[0] is None and r[2] < 4]  # rows that come twice
    table = spark.createDataFrame(rows, "k string, g long, i long, p double, q double, r double, t boolean")
    args = (["k"], ["p", "q", "r"], ["g", "i"], F.col("t"))
    key = lambda r: str(tuple(r))
    small = chain.impute_chain_neighbours(table, *args)
    got = sorted(small.collect(), key=key)
    assert not cuts  # the rows are not written before every search
    large = sorted(chain.impute_chain_neighbours(table, *args, group_rows=5).collect(), key=key)
    assert small.columns == table.columns and len(got) == len(large)
    for a, b in zip(got, large, strict=True):
        for c in table.columns:
            assert a[c] == b[c] or abs(a[c] - b[c]) < 1e-9, (a, b)
