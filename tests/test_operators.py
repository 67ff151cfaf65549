"""Operators on small hand-written rows."""

import json

import pytest
from pyspark.sql import functions as F

from cleanloom.operators import cleanse, encode, features, impute, inject, metrics, outliers, partitions, reports
from cleanloom.operators import scale as scaling
from cleanloom.operators import search, space, transfer
from cleanloom.operators.forest import SAMPLE, TREES, outlier_bounds, tree_hashes, wanted_by_trees
from cleanloom.operators.learners import estimator
from cleanloom.plans.grouping import Grouping
from cleanloom.sources import files

TRAIN = "is_train"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_rolling_needs_a_full_window_and_merges_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=200) + 1e6
    df = spark.createDataFrame([("s", i, None if i == 150 else float(x[i])) for i in range(200)], "k string, t int, v double")
    out = features.rolling_features(df, ["k"], ["t"], "v", {"m3": 3, "m90": 90}, {"s90": 90}).orderBy("t").collect()
    assert out[2]["m3"] is None and out[3]["m3"] == pytest.approx(x[:3].mean(), rel=1e-14)
    assert out[151]["m3"] is None and out[154]["m3"] == pytest.approx(x[151:154].mean(), rel=1e-14)
    assert out[89]["m90"] is None and out[151]["m90"] is None
    assert out[130]["m90"] == pytest.approx(x[40:130].mean(), rel=1e-14)
    assert out[130]["s90"] == pytest.approx(x[40:130].std(ddof=1), rel=1e-8)


def test_partitions_cover_rows_as_often_as_the_formula_says(spark):
    df = spark.createDataFrame([(i,) for i in range(23)], "t int")
    full = partitions.row_partitions(df, [], ["t"], 10, 4).groupBy("partition_id").agg(F.min("t"), F.count("t"))
    assert rows(full, *full.columns) == [(0, 0, 10), (1, 4, 10), (2, 8, 10), (3, 12, 10)]
    short = partitions.row_partitions(df, [], ["t"], 10, 4, keep_short=True).groupBy("partition_id").count()
    assert rows(short, "partition_id", "count") == [(0, 10), (1, 10), (2, 10), (3, 10), (4, 7), (5, 3)]


def test_injection_counts_are_exact_and_survive_repartitioning(spark):
    df = spark.createDataFrame([(i, i % 2, 1.0, 2.0, i % 5 != 0) for i in range(300)], "id int, k int, a double, b double, is_train boolean")
    out = inject.drop_cells_exact(df, ["k"], ["a", "b"], 0.1, ["id"], F.col(TRAIN))
    counts = out.groupBy("k").agg(F.sum(F.col("a").isNull().cast("int")).alias("a"), F.sum(F.col("b").isNull().cast("int")).alias("b"))
    assert rows(counts, "k", "a", "b") == [(0, 12, 12), (1, 12, 12)]
    assert out.where(~F.col(TRAIN) & (F.col("a").isNull() | F.col("b").isNull())).count() == 0
    again = inject.drop_cells_exact(df.repartition(9), ["k"], ["a", "b"], 0.1, ["id"], F.col(TRAIN))
    assert rows(out, *out.columns) == rows(again, *out.columns)
    hot = Grouping.of(df, ["k"], max_rows=60)
    spread = inject.drop_cells_exact(df, hot, ["a", "b"], 0.1, ["id"], F.col(TRAIN))
    assert rows(out, *out.columns) == rows(spread, *out.columns)


def test_statistics_come_from_training_rows_only(spark):
    data = [(1, 1.0, True), (1, 3.0, True), (1, None, True), (1, 900.0, False), (1, None, False), (None, 5.0, True), (None, None, False)]
    df = spark.createDataFrame(data, "k int, v double, is_train boolean")
    out = impute.impute(df, ["k"], ["v"], "mean", F.col(TRAIN))
    assert rows(out, "k", "v") == sorted([(1, 1.0), (1, 3.0), (1, 2.0), (1, 900.0), (1, 2.0), (None, 5.0), (None, 5.0)], key=repr)
    with pytest.raises(ValueError):
        impute.impute(df, ["k"], ["v"], "xgboost")


def test_sequential_means_of_no_cleaning(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 10.0, True), (2, None, 20.0, True), (3, 3.0, None, True), (4, 5.0, 30.0, True), (5, None, None, False)],
        "id int, a double, b double, is_train boolean",
    )
    out = impute.no_clean(df, [], ["a", "b"], F.col(TRAIN))
    # the mean of b skips row 2, which was dropped for its missing a
    assert rows(out, "id", "a", "b") == [(1, 1.0, 10.0), (4, 5.0, 30.0), (5, 3.0, 20.0)]


def test_scaling_constant_and_missing_columns(spark):
    df = spark.createDataFrame([(1, 4.0, None), (1, 4.0, None)], "k int, a double, b double")
    for kind in scaling.SCALERS:
        out = scaling.scale(df, ["k"], ["a", "b"], kind).first()
        assert out["b"] is None and out["a"] in (0.0, 1.0)


def test_cleaner_without_inliers_repairs_with_zero(spark):
    df = spark.createDataFrame([(1, v, True) for v in (0.0, 10.0)] + [(1, None, True)], "k int, v double, is_train boolean")
    out = outliers.clean_outliers(df, ["k"], ["v"], "ZS_0.5", F.col(TRAIN))
    assert rows(out, "v") == [(0.0,), (0.0,), (None,)]
    with pytest.raises(ValueError):
        outliers.clean_outliers(df, ["k"], ["v"], "XX_1")


def test_fence_repair_uses_the_repaired_training_mean_for_other_rows(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v, True) for v in values] + [(500.0, False)], "v double, is_train boolean")
    out = outliers.repair_with_fences(df, [], ["v"], "mean", F.col(TRAIN)).where(~F.col(TRAIN)).first()
    assert out["v"] == pytest.approx((1 + 2 + 3 + 4 + 22) / 5)


def test_forest_flags_far_values():
    import numpy as np

    pool = np.sort(np.concatenate([np.random.default_rng(0).normal(size=300), [50.0]]))
    first, bounds = outlier_bounds(pool, np.arange(301), 1)
    flagged = lambda x: first != (sum(b < x for b in bounds) % 2 == 1)
    assert flagged(50.0) and flagged(-30.0) and not flagged(0.0)


def test_forest_trees_draw_from_all_rows():
    import numpy as np

    rows = np.random.default_rng(1).integers(0, 1 << 52, 200_000)
    kept = wanted_by_trees(rows, np.full(len(rows), len(rows)))
    assert kept.mean() < 0.5
    drawn = set()
    for tree in range(TREES):
        best = np.argsort(tree_hashes(rows, tree), kind="stable")[:SAMPLE]
        assert kept[best].all()
        drawn.update(best.tolist())
    assert len(drawn) > 0.9 * TREES * SAMPLE
    small = wanted_by_trees(rows[:700], np.full(700, 700))
    assert small.all()


def test_one_hot_of_unknown_values_and_too_many_categories(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    out = encode.one_hot(df, {"c": ["a"]})
    assert rows(out, "c_a") == [(0,), (0,), (1,)]
    with pytest.raises(ValueError):
        encode.categories(df, ["c"], limit=1)


def test_bad_dates_and_sentinels(spark):
    df = spark.createDataFrame([(2020, 2, 30, -99.0), (2020, 2, 29, 5.0)], "Year int, Month int, Day int, AvgTemperature double")
    assert cleanse.date_from_parts(df, "Year", "Month", "Day").count() == 1
    assert rows(cleanse.sentinel_to_null(df), "AvgTemperature") == [(5.0,), (None,)]


def test_distance_rounds_to_tens_half_even(spark):
    day = 86_400_000_000
    df = spark.createDataFrame([(25 * day,), (35 * day,), (44 * day + 5,)], "m long")
    out = df.select(transfer.distance_in_days(F.lit(0), F.col("m")).alias("d"))
    assert rows(out, "d") == [(20,), (40,), (40,)]


def test_pairs_over_several_cells(spark, monkeypatch):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(11)] + [("t", 0, 0.0)], "s string, partition_id long, v double")
    whole = rows(transfer.partition_pairs(df, ["s"], ["v"]), "s", "i", "j", "v_i", "v_j")
    monkeypatch.setattr(transfer, "CELL", 3)
    assert rows(transfer.partition_pairs(df, ["s"], ["v"]), "s", "i", "j", "v_i", "v_j") == whole
    assert len(whole) == 55


def test_group_map_takes_the_last_duplicate_and_diagonal_counts_once(spark):
    scores = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.25), ("a", "x", 9.0)], "source string, target string, score double")
    names = spark.createDataFrame([("a", "old", 1), ("a", "G", 2), ("b", "G", 3)], "name string, group string, at int")
    matrix = transfer.group_matrix(transfer.map_groups(scores, names, order="at"))
    assert rows(matrix, "group_j", "group_i", "score") == [("G", "G", pytest.approx((0.5 + 0.25 + 1) / 3))]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 0, 0.1)], "y int, p int, s double")
    out = metrics.classification_metrics(df, [], "y", "p").first()
    assert out["accuracy"] == 0.75 and out["f1_weighted"] == pytest.approx((2 / 3 * 2 + 0.8 * 2) / 4)
    assert metrics.roc_auc(df, [], "y", "s").first()["auc"] == pytest.approx(3.5 / 4)


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([("f", "a", True, 0.1), ("f", "b", False, 2.0), ("f", "c", False, 700.0), ("g", "a", True, 1.0)], "feature string, option string, start boolean, l double")
    out = space.starting_probabilities(df, ["feature"], "start", 0.5)
    assert rows(out, "feature", "option", "prob") == [("f", "a", 0.5), ("f", "b", 0.25), ("f", "c", 0.25), ("g", "a", 1.0)]
    sums = space.softmax(df, ["feature"], "l").groupBy("feature").agg(F.sum("prob").alias("p"))
    assert all(r["p"] == pytest.approx(1) for r in sums.collect())


def test_balanced_matrix_has_unit_sums(spark):
    df = spark.createDataFrame([("m", i, j, float((i * 7 + j * 3) % 5)) for i in range(3) for j in range(3)], "f string, i int, j int, v double")
    out = space.balance(df, ["f"])
    for side in ("i", "j"):
        assert all(r[1] == pytest.approx(1, abs=1e-5) for r in out.groupBy(side).agg(F.sum("v")).collect())


def test_search_is_never_worse_than_its_start(spark):
    import random

    rnd = random.Random(1)
    data = []
    for i in range(300):
        a, b = rnd.gauss(0, 1), rnd.gauss(5, 2)
        data.append((i % 3, i, a if rnd.random() > 0.1 else None, b if rnd.random() > 0.1 else None, a - b + rnd.gauss(0, 0.1)))
    df = spark.createDataFrame(data, "k int, id int, a double, b double, y double")
    df = partitions.three_way_split(df, ["k"], [F.xxhash64("id"), F.col("id")])
    out = search.search_fixed(df, ["k"], ["a", "b"], "y", ["id"]).collect()
    assert len(out) == 3
    for r in out:
        assert r["best_val_loss"] <= r["start_val_loss"] + 1e-12 and len(r["choices"]) == 2


def test_grid_order_and_first_best(spark):
    found = space.grid_candidates({"a": [1, 2], "b": "x", "c": [3, 4]})
    assert [(f["a"], f["c"]) for f in found] == [(1, 3), (1, 4), (2, 3), (2, 4)] and found[0]["b"] == "x"
    df = spark.createDataFrame([(1.0,)], "v double")
    best = space.best_candidate(df, [], {"a": [5, 7]}, lambda p: F.col("v") + 0 * p["a"]).first()
    assert best["candidate"] == 0 and best["a"] == 5


def test_reports_need_lists_of_one_length(spark):
    df = spark.createDataFrame([(["m"], ["Z"]), (["m", "n"], ["Z"]), (["m"], ["Z"])], "num_tf array<string>, normalization array<string>")
    assert rows(reports.top_pairs(df), "imputer", "scaler", "uses") == [("m", "Z", 2)]
    assert reports.option_chains(df).first()["runs"] == 2


def test_unknown_model_is_an_error(spark):
    with pytest.raises(ValueError):
        estimator("unheard_of")


def test_series_and_partition_files(spark, tmp_path):
    header = "Date,Open,High,Low,Close,Adj Close,Volume\n"
    for name in ("AB_historical_data.csv", "CD.csv"):
        (tmp_path / name).write_text(header + "2020-01-02,1,2,0.5,1.5,1.5,100\n2020-01-03,NaN,2,0.5,,1.5,100\n")
    df = files.read_series(spark, str(tmp_path))
    assert rows(df.groupBy("symbol").agg(F.count("Open"), F.count("Close")), "symbol", "count(Open)", "count(Close)") == [("AB", 1, 1), ("CD", 1, 1)]
    files.write_partitions(df.withColumn("partition_id", F.lit(0)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_score_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "ridge", "m1", 0.5), ("a", 1, "ridge", "m2", 0.25)], "symbol string, partition_id long, model string, method string, rmse double")
    path = str(tmp_path / "12:30" / "scores")
    files.write_scores(df, path, ["symbol", "partition_id"], ["m1", "m2"])
    back = files.read_scores(spark, path.replace(":", "_"), ["m1", "m2"])
    assert rows(back, *df.columns) == rows(df, *df.columns)


def test_run_files(spark, tmp_path):
    for run, loss in (("A_full", 0.5), ("B_full", 0.25)):
        folder = tmp_path / "runs" / "fixed" / run
        folder.mkdir(parents=True)
        (folder / "result.json").write_text(json.dumps({"best_epoch": 3, "best_val_loss": loss, "best_tr_loss": 1, "best_test_loss": 2}, indent=1))
        (folder / "pipeline.json").write_text(json.dumps({"num_tf": ["mean"], "normalization": ["ZS"]}, indent=1))
    results = files.read_results(spark, str(tmp_path / "runs" / "*" / "*" / "result.json"))
    assert rows(results, "collection", "run", "best_val_loss") == [("runs", "A_full", 0.5), ("runs", "B_full", 0.25)]
    choices = files.read_choices(spark, str(tmp_path / "runs" / "*" / "*" / "pipeline.json"))
    assert rows(choices, "run", "num_tf") == [("A_full", ["mean"]), ("B_full", ["mean"])]
    files.write_runs(results, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_dataset_folder_and_listing(spark, tmp_path):
    (tmp_path / "data.csv").write_text("a,b,c,y\n1,x,nan,2\n,y,q,3\n")
    (tmp_path / "info.json").write_text(json.dumps({"label": "y", "drop_variables": ["b"], "categorical_variables": ["c"]}, indent=1))
    df, label = files.read_dataset(spark, str(tmp_path))
    assert label == "y" and df.columns == ["a", "c", "y"] and rows(df, "c") == [("q",), (None,)]
    (tmp_path / "list.txt").write_text("Symbol|Name\nAB|x\n123|y\nA.B|z\n|w\n")
    assert rows(files.read_listing(spark, str(tmp_path / "list.txt")), "Symbol") == [("AB",)]


def test_every_query_with_sql_names_a_query():
    from cleanloom.queries import catalog

    assert set(catalog.SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 100


def test_build_data_codes_the_label_and_drops_useless_columns(spark):
    from cleanloom.operators.build import build_data

    df = spark.createDataFrame([(i, f"n{i}", "ab"[i % 2] if i else None, 1.0, None) for i in range(20)], "id int, name string, y string, v double, void double")
    out = build_data(df, "y", ["id"], max_categories=5)
    assert out.columns == ["id", "y", "v", "split"]
    assert rows(out.groupBy("split").count(), "split", "count") == [("test", 4), ("train", 12), ("val", 4)]
    assert rows(out.where("id < 3"), "id", "y") == [(0, None), (1, 1), (2, 0)]


def test_pairs_up_to_a_distance(spark, monkeypatch):
    df = spark.range(40).select(F.lit("s").alias("k"), F.col("id").alias("partition_id"), (F.col("id") * 2).alias("v"))
    for cell in (256, 7):
        monkeypatch.setattr(transfer, "CELL", cell)
        every = rows(transfer.partition_pairs(df, ["k"], ["v"]), "i", "j", "v_i", "v_j")
        near = rows(transfer.partition_pairs(df, ["k"], ["v"], max_distance=9), "i", "j", "v_i", "v_j")
        assert len(every) == 40 * 39 // 2 and near == [r for r in every if r[1] - r[0] <= 9]


def test_search_takes_model_fills_and_rank_targets(spark):
    data = [("k", i, None if i % 7 == 3 else float(i % 11), float((i % 11) * 3 + (i % 2)), ("train", "train", "val", "test")[i % 4]) for i in range(80)]
    df = spark.createDataFrame(data, "k string, id int, x double, y double, split string")
    for target_as in ("value", "rank"):
        found = search.search_fixed(df, ["k"], ["x"], "y", ["id"], target_as=target_as).first()
        assert found["best_val_loss"] <= found["start_val_loss"] + 1e-12
    names = {o.name for o in space.preparation_space(models=True)[0].options}
    assert {"knn", "mice"} <= names
    with pytest.raises(ValueError):
        search.random_search(df, ["k"], ["x"], "y", space=space.preparation_space(models=True)).count()
    losses = search.random_search(df, ["k"], ["x"], "y", seeds=27, row_id=["id"])
    assert losses.where("best_val_loss is not null").count() == 27
    with pytest.raises(ValueError):
        search.search_fixed(df, ["k"], ["x"], "y", ["id"], target_as="log")


def test_average_rank_distance_over_all_pairs(spark, monkeypatch):
    from cleanloom.queries import transfer as queries

    values = {(p, m): float((p * k * k + k) % 3) for p in range(7) for k, m in enumerate("ABC", 2)}
    scores = [(1, p, "lm", m, v, p * 10 * 86_400_000_000) for (p, m), v in values.items()]
    table = spark.createDataFrame(scores, "l_suppkey int, partition_id int, model string, method string, rmse double, mid long")
    monkeypatch.setattr(queries, "_placed_scores", lambda *_: table)
    rank = {}
    for p, m in values:
        others = [values[p, o] for o in "ABC"]
        rank[p, m] = sum(v < values[p, m] for v in others) + (others.count(values[p, m]) + 1) / 2
    for name, most in (("rank_average_by_distance_all", 6), ("rank_average_by_distance", 3)):
        want = {}
        for m in "ABC":
            for step in range(1, most + 1):
                pairs = [abs(rank[p, m] - rank[p + step, m]) for p in range(7 - step)]
                want[m, step * 10] = (sum(pairs) / len(pairs), len(pairs))
        rows_ = getattr(queries, name)(spark, "").collect()
        got = {(r["method"], int(r["distance"])): (r["rank_difference"], r["n_pairs"]) for r in rows_}
        assert got.keys() == want.keys()
        assert all(abs(got[k][0] - want[k][0]) < 1e-5 and got[k][1] == want[k][1] for k in want)


def test_models_have_the_reference_sizes():
    import inspect

    from cleanloom.operators import learners

    assert {estimator(n).getMaxDepth() for n in ("decision_tree", "random_forest", "rf_regressor")} == {learners.DEEPEST}
    assert estimator("svm").getClassifier().getMaxIter() >= 1000
    assert inspect.signature(learners._ada_boost).parameters["rounds"].default == 50
    forest = estimator("random_forest")
    assert {g[forest.numTrees] for g in learners.grid("random_forest", forest, 10)} == {10, 100, 1000}
