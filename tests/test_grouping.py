"""The path for hot groups must give what the plain path gives."""

import random

import pytest
from pyspark.sql import functions as F

from cleanloom.plans import stats as st
from cleanloom.plans.grouping import Grouping


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = []
    for i in range(400):
        key = None if i % 29 == 0 else ("big" if i % 3 else f"k{i % 5}")
        # half of the hot group shares one time, so slices of the first order column stay too large
        t = 50 if i % 2 else rnd.randrange(1000)
        v = None if i % 13 == 0 else float(rnd.randrange(12))
        data.append((i, key, t, f"prefix-prefix-prefix-{i:04d}", v, rnd.choice("abc")))
    return spark.createDataFrame(data, "id long, key string, t long, name string, v double, c string").repartition(3)


def both(rows, keys):
    plain = Grouping.of(rows, keys, max_rows=10**6)
    spread = Grouping.of(rows, keys, max_rows=25)
    assert plain.hot is None and spread.hot is not None
    return plain, spread


def same(a, b):
    left, right = (sorted(map(repr, x.select(sorted(x.columns)).collect())) for x in (a, b))
    assert left == right and left


@pytest.mark.parametrize("keys", [["key"], ["key", "c"], []])
def test_number(rows, keys):
    plain, spread = both(rows, keys)
    same(plain.number(rows, ["t", "id"]), spread.number(rows, ["t", "id"]))
    same(plain.number(rows, ["name"]), spread.number(rows, ["name"]))
    same(plain.number(rows, [F.col("v") * 2, F.col("id")]), spread.number(rows, [F.col("v") * 2, F.col("id")]))


@pytest.mark.parametrize("keys", [["key"], []])
def test_over_rows(rows, keys):
    plain, spread = both(rows, keys)

    def build(df, w):
        return df.withColumns({"s": F.sum("v").over(w.rowsBetween(-3, -1)), "ahead": F.lead("id", 2).over(w)})

    same(plain.over_rows(rows, ["t", "id"], 3, 2, build), spread.over_rows(rows, ["t", "id"], 3, 2, build))


@pytest.mark.parametrize("keys", [["key"], []])
def test_stats(rows, keys):
    plain, spread = both(rows, keys)
    specs = {
        "n": st.count("v"),
        "q": st.quantiles("v", [0.1, 0.25, 0.5, 0.97]),
        "m": st.mode("v"),
        "cuts": st.cuts("v", 5),
        "many_cuts": st.cuts("t", 60),
        "mc": st.mode("c"),
        "even": st.quantiles("id", [0.03, 0.5]).only(F.col("id") % 2 == 0),
        "hi": st.high("v"),
    }
    same(plain.stats(rows, specs), spread.stats(rows, specs))
    same(plain.with_stats(rows, specs), spread.with_stats(rows, specs))


@pytest.mark.parametrize("ties", ["average", "min"])
def test_rank(rows, ties):
    plain, spread = both(rows, ["key"])
    same(plain.rank(rows, "v", ties), spread.rank(rows, "v", ties))


def test_bounded_grouping_uses_windows_only(rows):
    g = Grouping.bounded(["key"])
    specs = {"m": st.median("v"), "top": st.mode("c"), "cuts": st.cuts("v", 5)}
    out = g.with_stats(rows, specs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    same(out, Grouping.of(rows, ["key"], max_rows=10**6).with_stats(rows, specs))


def test_several_passes_agree(rows):
    from cleanloom.operators.outliers import clean_outliers

    plain, spread = both(rows, ["key"])
    a, b = (clean_outliers(rows, g, ["v"], "MAD_2") for g in (plain, spread))
    same(a.withColumn("v", F.round("v", 9)), b.withColumn("v", F.round("v", 9)))


def test_many_groups_take_the_other_way(rows, monkeypatch):
    from cleanloom.operators.outliers import clean_outliers
    from cleanloom.plans import grouping as module

    few = clean_outliers(rows, Grouping.of(rows, ["key"], max_rows=25), ["v"], "IQR_1", F.col("id") % 3 != 0)
    monkeypatch.setattr(module, "FEW_GROUPS", 2)
    for max_rows in (25, 10**6):
        g = Grouping.of(rows, ["key"], max_rows=max_rows)
        assert not g.few
        many = clean_outliers(rows, g, ["v"], "IQR_1", F.col("id") % 3 != 0)
        same(few.withColumn("v", F.round("v", 9)), many.withColumn("v", F.round("v", 9)))


def test_hot_rows_are_dealt_out_whatever_their_order_column(spark):
    """Long common beginnings, an infinite value and a heavy tail do not keep rows together."""
    import math

    from cleanloom.plans.ordered import running_total, split_in_order

    rows = [("k", "a" * 24 + f"{i:06d}", math.exp(i / 20) if i else float("inf"), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, t string, x double, id long")
    for order in (["t"], ["x", "id"]):
        parts = split_in_order(df, ["k"], order, 500).groupBy("_part").count().collect()
        assert max(r["count"] for r in parts) <= 500
    at = {r["id"]: r["_upto"] for r in running_total(df, ["k"], ["t"], 500).collect()}
    assert all(at[i] == i + 1 for i in range(6000))
