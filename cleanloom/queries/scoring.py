"""Queries that fill by models, fit models, score predictions and run the cleaning sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.operators import features, learners, metrics, partitions, sweep as sweeps
from cleanloom.operators.encode import categories, label_encode, one_hot
from cleanloom.operators.forest import repair_with_forest
from cleanloom.operators.impute_chain import impute_chain, impute_chain_neighbours, impute_chain_trees, impute_em
from cleanloom.operators.impute_knn import impute_knn as fill_knn
from cleanloom.operators.impute_knn import knn_classify as vote_knn
from cleanloom.operators.linear import ALPHAS, TEST_PART, fit_linear
from cleanloom.operators.trees import boost
from cleanloom.plans.grouping import Grouping
from cleanloom.queries.inputs import (
    EVENT_ORDER,
    EVENT_SQL,
    GAPPY_SQL,
    LINE_ID,
    LINE_ORDER,
    LINE_VALUES,
    event_shuffle,
    event_shuffle_sql,
    gappy_lines,
    line_shuffle,
    line_shuffle_sql,
    lines,
    user_events,
)
from cleanloom.queries.registry import query, rounded, sql_rounded, table
from cleanloom.queries.series import LINE_ROWS, _partition_sql

SUPPLIER = ["l_suppkey"]
IDS = "l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey"


def is_train() -> Column:
    return F.col("is_train")


def _cells(out: DataFrame, digits: int = 6) -> DataFrame:
    return out.select("l_suppkey", *LINE_ID, *[rounded(c, digits).alias(c) for c in LINE_VALUES])


# -- filling by models ----------------------------------------------------------------------------------------------


def _knn_sql() -> str:
    ids = [i.strip() for i in IDS.split(",")]
    pattern = " + ".join(f"CASE WHEN {c} IS NULL THEN {1 << i} ELSE 0 END" for i, c in enumerate(LINE_VALUES))
    shared = " + ".join(f"CASE WHEN i.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in LINE_VALUES)
    total = " + ".join(f"coalesce((i.{c} - d.{c}) * (i.{c} - d.{c}), 0)" for c in LINE_VALUES)
    pairs = f"""SELECT {", ".join(f"i.{x}" for x in ids)}, {", ".join(f"i.{c} AS i_{c}, d.{c} AS d_{c}" for c in LINE_VALUES)},
      ({total}) * ({len(LINE_VALUES)}::DOUBLE / ({shared})) AS gap, d.pattern AS d_pattern,
      {", ".join(f"d.{x} AS d_{x}" for x in ids[1:])}
      FROM g i JOIN g d ON i.l_suppkey = d.l_suppkey AND i.pattern > 0 AND d.is_train AND ({shared}) > 0"""
    order = "gap, d_pattern, d_qty NULLS FIRST, " + ", ".join(f"d_{x}" for x in ids[1:])
    parts = [f"g AS (SELECT *, {pattern} AS pattern FROM ({GAPPY_SQL}))", f"p AS ({pairs})"]
    for c in LINE_VALUES:
        parts.append(
            f"""k_{c} AS (SELECT {IDS}, avg(d_{c}) AS v FROM (SELECT *, row_number() OVER (PARTITION BY {IDS} ORDER BY {order}) AS rn
            FROM p WHERE i_{c} IS NULL AND d_{c} IS NOT NULL) WHERE rn <= 5 GROUP BY {IDS})"""
        )
    same = " AND ".join(f"k_{{c}}.{x} = g.{x}" for x in ids)
    joins = " ".join(f"LEFT JOIN k_{c} ON {same.format(c=c)}" for c in LINE_VALUES)
    cells = ", ".join(
        sql_rounded(f"coalesce(g.{c}, k_{c}.v, avg(g.{c}) FILTER (WHERE g.is_train) OVER (PARTITION BY g.l_suppkey))") + f" AS {c}"
        for c in LINE_VALUES
    )
    return f"""WITH {", ".join(parts)} SELECT g.l_suppkey, g.l_orderkey, g.l_linenumber, g.l_partkey, {cells} FROM g {joins}"""


@query("impute_knn", _knn_sql())
def impute_knn(spark, folder) -> DataFrame:
    return _cells(fill_knn(gappy_lines(spark, folder), SUPPLIER, LINE_VALUES, LINE_ORDER, is_train()))


@query("impute_chain")
def impute_chain_ridge(spark, folder) -> DataFrame:
    return _cells(impute_chain(gappy_lines(spark, folder), SUPPLIER, LINE_VALUES, LINE_ORDER, is_train()))


@query("impute_chain_neighbours")
def impute_chain_knn(spark, folder) -> DataFrame:
    return _cells(
        impute_chain_neighbours(gappy_lines(spark, folder), SUPPLIER, LINE_VALUES, LINE_ORDER, is_train())
    )


@query("impute_chain_tree_by_key")
def impute_chain_tree_by_key(spark, folder) -> DataFrame:
    """Chained equations with regression trees of every supplier's order lines."""
    return _cells(impute_chain(gappy_lines(spark, folder), SUPPLIER, LINE_VALUES, LINE_ORDER, is_train(), estimator="tree"))


@query("impute_chain_tree")
def impute_chain_tree(spark, folder) -> DataFrame:
    return _cells(impute_chain_trees(gappy_lines(spark, folder), LINE_VALUES, is_train()))


@query("impute_tree")
def impute_random_tree(spark, folder) -> DataFrame:
    return _cells(impute_chain_trees(gappy_lines(spark, folder), LINE_VALUES, is_train(), randomised=True))


@query("impute_em")
def impute_gaussian(spark, folder) -> DataFrame:
    return _cells(impute_em(gappy_lines(spark, folder), SUPPLIER, LINE_VALUES, LINE_ORDER, is_train()))


@query("outlier_iforest")
def outlier_iforest(spark, folder) -> DataFrame:
    rows = user_events(spark, folder).withColumn("is_train", F.col("event_id") % 5 != 0)
    out = repair_with_forest(rows, ["user_id"], ["amount"], "median", ["event_id"], is_train())
    return out.select("event_id", "user_id", "amount")


# -- linear models with one feature: value on the mean of the five values before ---------------------------------------


def _lagged_events(spark, folder) -> DataFrame:
    rows = features.rolling_features(user_events(spark, folder), ["user_id"], EVENT_ORDER, "amount", {"past": 5}, {})
    split = partitions.hold_out(rows.where(F.col("past").isNotNull()), ["user_id"], event_shuffle())
    # fold numbers among the training rows only
    train = partitions.k_fold(split.where(F.col("split") == "train"), ["user_id"], EVENT_ORDER)
    test = split.where(F.col("split") == "test").withColumn("fold", F.lit(TEST_PART))
    return train.unionByName(test)


def _grid_sql(keys: str, model: str) -> str:
    """Grid search over standardised rows ``k`` (keys, part, x, y), part -1 being the test rows."""
    grid = {
        "ridge": [(a, i) for a in ALPHAS for i in (True, False)],
        "lasso": [(a, True) for a in ALPHAS],
        "linear_regression": [(0.0, True), (0.0, False)],
    }[model]
    values = ", ".join(f"({k}, {a}::DOUBLE, {str(i).lower()})" for k, (a, i) in enumerate(grid))
    slope = {
        "ridge": "{xy} / ({xx} + alpha)",
        "linear_regression": "{xy} / {xx}",
        "lasso": "sign({xy}) * greatest(abs({xy}) - {n} * alpha, 0) / {xx}",
    }[model]
    names = [k.strip() for k in keys.split(",")]

    def same(a: str, b: str) -> str:
        return " AND ".join(f"{a}.{k} = {b}.{k}" for k in names)

    def fitted(n: str, sx: str, sy: str, xx: str, xy: str) -> str:
        centred = slope.format(n=n, xx=f"({xx} - {sx} * {sx} / {n})", xy=f"({xy} - {sx} * {sy} / {n})")
        plain = slope.format(n=n, xx=xx, xy=xy)
        return f"CASE WHEN icpt THEN {centred} ELSE {plain} END"

    def loss(p: str) -> str:
        return (
            f"({p}.yy - 2 * w * {p}.xy - 2 * b * {p}.sy + w * w * {p}.xx + 2 * w * b * {p}.sx + b * b * {p}.n) / {p}.n"
        )

    return f"""s AS (SELECT {keys}, part, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(x * y) AS xy,
        sum(y * y) AS yy FROM k GROUP BY {keys}, part),
    a AS (SELECT {keys}, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(xx) AS xx, sum(xy) AS xy, sum(yy) AS yy
      FROM s WHERE part >= 0 GROUP BY {keys}),
    grid(idx, alpha, icpt) AS (VALUES {values}),
    w AS (SELECT s.*, grid.*, a.n - s.n AS tn, a.sx - s.sx AS tsx, a.sy - s.sy AS tsy,
        {fitted("(a.n - s.n)", "(a.sx - s.sx)", "(a.sy - s.sy)", "(a.xx - s.xx)", "(a.xy - s.xy)")} AS w
      FROM s JOIN a ON {same("a", "s")} CROSS JOIN grid WHERE s.part >= 0),
    v AS (SELECT *, CASE WHEN icpt THEN (tsy - w * tsx) / tn ELSE 0 END AS b FROM w),
    c AS (SELECT {keys}, idx, alpha, icpt, avg({loss("v")}) AS cv FROM v GROUP BY {keys}, idx, alpha, icpt),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY cv, idx) AS rn FROM c) WHERE rn = 1),
    fin AS (SELECT best.*, a.n AS an, a.sx AS asx, a.sy AS asy, {fitted("a.n", "a.sx", "a.sy", "a.xx", "a.xy")} AS w
      FROM best JOIN a ON {same("a", "best")}),
    fb AS (SELECT *, CASE WHEN icpt THEN (asy - w * asx) / an ELSE 0 END AS b FROM fin)
    SELECT {", ".join(f"fb.{k}" for k in names)}, fb.alpha, {sql_rounded("fb.cv", 5)} AS cv_mse,
      {sql_rounded(f"sqrt({loss('s')})", 5)} AS test_rmse, CAST(fb.an AS BIGINT) AS n_train, CAST(s.n AS BIGINT) AS n_test
    FROM fb JOIN s ON {same("s", "fb")} AND s.part = -1"""


def _fold_sql(position: str, n: str) -> str:
    """The contiguous fold of a 0-based position among n rows."""
    q, m = f"({n} // 5)", f"({n} % 5)"
    return (
        f"CASE WHEN {position} < {m} * ({q} + 1) THEN {position} // ({q} + 1)"
        f" ELSE {m} + ({position} - {m} * ({q} + 1)) // greatest({q}, 1) END"
    )


def _linear_sql(model: str) -> str:
    return f"""WITH e AS (
      SELECT *, CASE WHEN count(amount) OVER f = 5 THEN avg(amount) OVER f END AS past FROM ({EVENT_SQL})
      WINDOW f AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
    h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {event_shuffle_sql()})
        <= round_even(0.2::DOUBLE * count(*) OVER (PARTITION BY user_id), 0) AS is_test FROM e WHERE past IS NOT NULL),
    t AS (SELECT *, row_number() OVER (PARTITION BY user_id, is_test ORDER BY ts) - 1 AS r,
        count(*) OVER (PARTITION BY user_id, is_test) AS n FROM h),
    k AS (SELECT user_id, CASE WHEN is_test THEN -1 ELSE {_fold_sql("r", "n")} END AS part,
        (past - avg(past) FILTER (WHERE NOT is_test) OVER u) / stddev_pop(past) FILTER (WHERE NOT is_test) OVER u AS x,
        (amount - avg(amount) FILTER (WHERE NOT is_test) OVER u) / stddev_pop(amount) FILTER (WHERE NOT is_test) OVER u AS y
      FROM t WINDOW u AS (PARTITION BY user_id)), {_grid_sql("user_id", model)}"""


def _linear(spark, folder, model: str) -> DataFrame:
    rows = _lagged_events(spark, folder)
    out = fit_linear(rows, ["user_id"], ["past"], "amount", F.col("fold"), model)
    return out.select(
        "user_id", "alpha", rounded("cv_mse", 5).alias("cv_mse"), rounded("test_rmse", 5).alias("test_rmse"), "n_train", "n_test"
    )


@query("ridge_grid", _linear_sql("ridge"))
def ridge_grid(spark, folder) -> DataFrame:
    return _linear(spark, folder, "ridge")


@query("lasso_grid", _linear_sql("lasso"))
def lasso_grid(spark, folder) -> DataFrame:
    return _linear(spark, folder, "lasso")


@query("linear", _linear_sql("linear_regression"))
def linear(spark, folder) -> DataFrame:
    return _linear(spark, folder, "linear_regression")


# -- metrics --------------------------------------------------------------------------------------------------------


@query(
    "metrics_regression",
    f"""SELECT o_orderstatus, {sql_rounded("avg((y - p) * (y - p))", 3)} AS mse, {sql_rounded("sqrt(avg((y - p) * (y - p)))", 5)} AS rmse,
      {sql_rounded("avg(abs(y - p))", 5)} AS mae, {sql_rounded("1 - avg((y - p) * (y - p)) / var_pop(y)")} AS r2,
      printf('%.4f', round(sqrt(avg((y - p) * (y - p))), 4)) AS rmse_text
    FROM (SELECT o_orderstatus, round(o_totalprice) AS y, round(o_totalprice) + (o_orderkey * 7919) % 2003 - 1001 AS p FROM orders)
    GROUP BY o_orderstatus""",
)
def metrics_regression(spark, folder) -> DataFrame:
    actual = F.round("o_totalprice")
    rows = table(spark, folder, "orders").select(
        "o_orderstatus", actual.alias("y"), (actual + (F.col("o_orderkey") * 7919) % 2003 - 1001).alias("p")
    )
    out = metrics.regression_metrics(rows, ["o_orderstatus"], "y", "p")
    return out.select(
        "o_orderstatus", rounded("mse", 3).alias("mse"), rounded("rmse", 5).alias("rmse"), rounded("mae", 5).alias("mae"),
        rounded("r2").alias("r2"), metrics.score_text(F.col("rmse")).alias("rmse_text"),
    )


@query(
    "metrics_classification",
    f"""WITH p AS (SELECT source, quality AS y, CASE WHEN n_chars % 3 = 0 THEN toxic ELSE quality END AS p
        FROM labels JOIN documents USING (doc_id)),
      l AS (SELECT source, label, sum(CASE WHEN y = label THEN 1 ELSE 0 END) AS sup, sum(CASE WHEN p = label THEN 1 ELSE 0 END) AS gue,
        sum(CASE WHEN y = label AND p = label THEN 1 ELSE 0 END) AS hit
        FROM p CROSS JOIN (VALUES (0), (1)) v(label) GROUP BY source, label)
    SELECT source, {sql_rounded("sum(hit)::DOUBLE / sum(sup)")} AS accuracy,
      {sql_rounded("sum(CASE WHEN sup + gue > 0 THEN 2.0::DOUBLE * hit / (sup + gue) * sup ELSE 0 END) / sum(sup)")} AS f1_weighted
    FROM l GROUP BY source""",
)
def metrics_classification(spark, folder) -> DataFrame:
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    guess = F.when(F.col("n_chars") % 3 == 0, F.col("toxic")).otherwise(F.col("quality"))
    out = metrics.classification_metrics(rows.withColumn("guess", guess), ["source"], "quality", "guess")
    return out.select("source", rounded("accuracy").alias("accuracy"), rounded("f1_weighted").alias("f1_weighted"))


@query(
    "metrics_auc",
    f"""WITH r AS (SELECT source, quality AS y, rank() OVER (PARTITION BY source ORDER BY n_chars % 50)
        + (count(*) OVER (PARTITION BY source, n_chars % 50) - 1) / 2.0::DOUBLE AS r
      FROM labels JOIN documents USING (doc_id))
    SELECT source, {sql_rounded("(sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0)::DOUBLE")} AS auc
    FROM r GROUP BY source""",
)
def metrics_auc(spark, folder) -> DataFrame:
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    scored = rows.select("source", "quality", (F.col("n_chars") % 50).cast("double").alias("score"))
    return metrics.roc_auc(scored, ["source"], "quality", "score").select("source", rounded("auc").alias("auc"))


@query(
    "knn_classify",
    """WITH c AS (SELECT c_custkey, round(c_acctbal * 100) AS bal, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code,
        c_custkey % 5 <> 0 AS is_train FROM customer),
      n AS (SELECT q.c_custkey, d.code, row_number() OVER (PARTITION BY q.c_custkey
          ORDER BY (q.bal - d.bal) * (q.bal - d.bal), d.bal, d.c_custkey) AS rn
        FROM c q JOIN c d ON NOT q.is_train AND d.is_train),
      v AS (SELECT c_custkey, code, row_number() OVER (PARTITION BY c_custkey ORDER BY count(*) DESC, code) AS rn
        FROM n WHERE rn <= 5 GROUP BY c_custkey, code)
    SELECT c_custkey, CAST(code AS DOUBLE) AS predicted FROM v WHERE rn = 1""",
)
def knn_classify(spark, folder) -> DataFrame:
    rows = table(spark, folder, "customer").select(
        "c_custkey", F.round(F.col("c_acctbal") * 100).alias("bal"), "c_mktsegment", (F.col("c_custkey") % 5 != 0).alias("is_train")
    )
    coded = label_encode(rows, "c_mktsegment", "code")
    return vote_knn(coded, [], ["bal"], "code", ["c_custkey"], is_train())


# -- whole-table models -----------------------------------------------------------------------------------------------


def _labelled(spark, folder) -> tuple[DataFrame, DataFrame, list[str]]:
    rows = table(spark, folder, "labels").join(
        table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id"
    )
    vocabulary = categories(rows, ["lang", "source"])
    encoded = one_hot(rows, vocabulary)
    names = [f"{c}_{v}" for c, vs in vocabulary.items() for v in vs]
    plain = [f"x{i}" for i in range(len(names))]
    encoded = encoded.withColumnsRenamed(dict(zip(names, plain, strict=True)))
    test = F.col("doc_id") % 5 == 0
    return encoded.where(~test), encoded.where(test), ["n_chars", *plain]


def _naive_bayes_sql() -> str:
    """Gaussian likelihoods per class and feature, variances widened by a billionth of the largest variance."""
    return """WITH r AS (SELECT doc_id, quality, lang, source, n_chars FROM labels JOIN documents USING (doc_id)),
      f(kind, cat) AS (SELECT DISTINCT 'lang', lang FROM r WHERE lang IS NOT NULL UNION ALL SELECT DISTINCT 'source', source FROM r WHERE source IS NOT NULL),
      x AS (SELECT doc_id, quality, 'n_chars' AS kind, '' AS cat, n_chars::DOUBLE AS v FROM r
        UNION ALL SELECT doc_id, quality, kind, cat,
          CASE WHEN CASE kind WHEN 'lang' THEN lang ELSE source END = cat THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM r, f),
      t AS (SELECT * FROM x WHERE doc_id % 5 <> 0),
      e AS (SELECT max(s) * 1e-9 AS eps FROM (SELECT avg(v * v) - avg(v) * avg(v) AS s FROM t GROUP BY kind, cat)),
      g AS (SELECT quality AS y, kind, cat, avg(v) AS m, avg(v * v) - avg(v) * avg(v) + any_value(eps) AS s FROM t, e GROUP BY ALL),
      p AS (SELECT quality AS y, ln(count(*)::DOUBLE) AS prior FROM r WHERE doc_id % 5 <> 0 GROUP BY quality),
      l AS (SELECT x.doc_id, x.quality, g.y, any_value(p.prior) - 0.5 * sum(ln(g.s) + (x.v - g.m) * (x.v - g.m) / g.s) AS score
        FROM x JOIN g ON x.kind = g.kind AND x.cat = g.cat JOIN p ON p.y = g.y WHERE x.doc_id % 5 = 0 GROUP BY x.doc_id, x.quality, g.y)
    SELECT doc_id, quality, CAST(y AS DOUBLE) AS prediction FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, y) AS rn FROM l) WHERE rn = 1"""


def _model_query(name: str, model: str, sql: str | None = None) -> None:
    @query(name, sql)
    def run(spark, folder) -> DataFrame:
        train, test, columns = _labelled(spark, folder)
        return learners.predict(train, test, columns, "quality", model).select("doc_id", "quality", "prediction")


for _name, _model in (
    ("model_logistic", "logistic_regression"),
    ("model_tree", "decision_tree"),
    ("model_forest", "random_forest"),
    ("model_svm", "svm"),
    ("model_boost", "ada_boost"),
    ("model_rf_regressor", "rf_regressor"),
    ("model_gbt", "gbt_regressor"),
):
    _model_query(_name, _model)
_model_query("model_nb", "naive_bayes", _naive_bayes_sql())


@query("boost_by_key")
def boost_by_key(spark, folder) -> DataFrame:
    """A boosted regressor of the price of every supplier's order lines, 50 trees each; predictions of the held-out lines."""
    rows = gappy_lines(spark, folder).where("price IS NOT NULL")
    found = boost(rows, SUPPLIER, ["qty", "disc", "tax"], "price", LINE_ID, F.col("is_train"), trees=50)
    return found.where("NOT is_train").select("l_suppkey", *LINE_ID, rounded("prediction", 3).alias("prediction"))


# -- the sweep ------------------------------------------------------------------------------------------------------

FEATURES, TARGET = ["qty", "disc", "tax", "day_5", "day_30", "std_5"], "price"


def _series_partitions(spark, folder) -> DataFrame:
    rows = lines(spark, folder).drop("is_train", "l_returnflag")
    by = Grouping.of(rows, SUPPLIER)
    lagged = features.rolling_features(rows, by, LINE_ORDER, "price", {"day_5": 5, "day_30": 30}, {"std_5": 5})
    return partitions.row_partitions(lagged, by, LINE_ORDER, 400, 100)


@query("sweep")
def sweep(spark, folder) -> DataFrame:
    """Six cleaning methods on every partition of every supplier's series."""
    parts = _series_partitions(spark, folder)
    return sweeps.sweep(parts, ["l_suppkey", "partition_id"], FEATURES, TARGET, ["series_row"], LINE_ID)


@query("sweep_trees")
def sweep_trees(spark, folder) -> DataFrame:
    """The sweep with a regression tree of each partition and column in the chained fill."""
    parts = _series_partitions(spark, folder)
    return sweeps.sweep(parts, ["l_suppkey", "partition_id"], FEATURES, TARGET, ["series_row"], LINE_ID, chain="tree")


@query("sweep_outliers")
def sweep_outliers(spark, folder) -> DataFrame:
    """Five imputers, three detectors and two repairs on every partition."""
    parts = _series_partitions(spark, folder)
    return sweeps.sweep_outliers(parts, ["l_suppkey", "partition_id"], FEATURES, TARGET, ["series_row"], LINE_ID)


def _sweep_sql() -> str:
    """The sweep with one feature: split, gaps, fills, folds, scaling and grid search step by step."""
    key = "l_suppkey, partition_id"
    rows = _partition_sql(LINE_ROWS, "l_suppkey, l_orderkey, l_linenumber, l_partkey, qty, price", "400", "100")
    fills = {
        "mean_noclean": f"coalesce(q, avg(q) FILTER (WHERE tr) OVER (PARTITION BY {key}))",
        "median_noclean": f"coalesce(q, quantile_cont(q, 0.5) FILTER (WHERE tr) OVER (PARTITION BY {key}))",
        "mode_noclean": "coalesce(q, mode)",
    }
    cases = " UNION ALL ".join(
        f"SELECT {key}, '{m}' AS method, tr, series_row, {x} AS x, price AS y FROM g JOIN mo USING ({key})" for m, x in fills.items()
    )
    return f"""WITH p AS ({rows}),
    h AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {line_shuffle_sql(0)})
        > round_even(0.2::DOUBLE * count(*) OVER (PARTITION BY {key}), 0) AS tr FROM p),
    g AS (SELECT *, CASE WHEN tr AND row_number() OVER (PARTITION BY {key}, tr ORDER BY {line_shuffle_sql(1)})
        <= floor(0.05::DOUBLE * count(*) OVER (PARTITION BY {key}, tr)) THEN NULL ELSE qty END AS q FROM h),
    mo AS (SELECT {key}, q AS mode FROM (SELECT {key}, q, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, q) AS rn
      FROM g WHERE tr AND q IS NOT NULL GROUP BY {key}, q) WHERE rn = 1),
    u AS ({cases} UNION ALL SELECT {key}, 'Noclean', tr, series_row, q, price FROM g WHERE q IS NOT NULL),
    t AS (SELECT *, row_number() OVER (PARTITION BY {key}, method, tr ORDER BY series_row) - 1 AS r,
        count(*) OVER (PARTITION BY {key}, method, tr) AS n FROM u),
    k AS (SELECT {key}, method, CASE WHEN tr THEN {_fold_sql("r", "n")} ELSE -1 END AS part,
        (x - avg(x) FILTER (WHERE tr) OVER m) / stddev_pop(x) FILTER (WHERE tr) OVER m AS x,
        (y - avg(y) FILTER (WHERE tr) OVER m) / stddev_pop(y) FILTER (WHERE tr) OVER m AS y
      FROM t WINDOW m AS (PARTITION BY {key}, method)), {_grid_sql(key + ", method", "ridge")}"""


@query("sweep_one_feature", _sweep_sql())
def sweep_one_feature(spark, folder) -> DataFrame:
    """The sweep with quantity as the only feature; the two fills that SQL cannot say are left out of the result."""
    rows = lines(spark, folder).select("l_suppkey", *LINE_ORDER, "qty", "price")
    parts = partitions.row_partitions(rows, SUPPLIER, LINE_ORDER, 400, 100)
    out = sweeps.sweep(
        parts, ["l_suppkey", "partition_id"], ["qty"], "price", ["series_row"], LINE_ID, drop_share=0.05, order=line_shuffle
    )
    return out.where(~F.col("method").isin("knn_noclean", "mice_noclean")).select(
        "l_suppkey", "partition_id", "method", "alpha", rounded("cv_mse", 5).alias("cv_mse"),
        rounded("rmse", 5).alias("test_rmse"), "n_train", "n_test",
    )
