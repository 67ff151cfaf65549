"""Queries on the preparation space and its search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.operators import learn, partitions, reports, search, space
from cleanloom.operators.scale import SCALERS, scaler_option
from cleanloom.plans.grouping import Grouping
from cleanloom.queries.inputs import GAPPY_SQL, LINE_ID, LINE_SQL, gappy_lines, line_shuffle, lines
from cleanloom.queries.registry import query, rounded, sql_rounded, table

SUPPLIER = ["l_suppkey"]
IDS = "l_suppkey, l_orderkey, l_linenumber, l_partkey"
FEATURES, TARGET = ["qty", "disc", "tax"], "price"
OVER = "OVER (PARTITION BY l_suppkey)"
TRAIN = f"FILTER (WHERE is_train) {OVER}"


def is_train() -> Column:
    return F.col("is_train")


def _split_lines(spark, folder) -> DataFrame:
    return partitions.three_way_split(gappy_lines(spark, folder).drop("is_train"), SUPPLIER, line_shuffle())


@query(
    "prepare_default",
    f"SELECT {IDS}, "
    + ", ".join(
        sql_rounded(f"(f_{c} - avg(f_{c}) {TRAIN}) / CASE WHEN stddev_pop(f_{c}) {TRAIN} = 0 THEN 1 ELSE stddev_pop(f_{c}) {TRAIN} END")
        + f" AS {c}"
        for c in FEATURES
    )
    + f" FROM (SELECT *, {', '.join(f'coalesce({c}, avg({c}) {TRAIN}) AS f_{c}' for c in FEATURES)} FROM ({GAPPY_SQL}))",
)
def prepare_default(spark, folder) -> DataFrame:
    out = space.prepare_default(gappy_lines(spark, folder), SUPPLIER, FEATURES, is_train())
    return out.select("l_suppkey", *LINE_ID, *[rounded(c).alias(c) for c in FEATURES])


SCALED_SQL = {
    "ZS": f"(qty - avg(qty) {OVER}) / stddev_pop(qty) {OVER}",
    "MM": f"(qty - min(qty) {OVER}) / (max(qty) {OVER} - min(qty) {OVER})",
    "MA": f"qty / max(abs(qty)) {OVER}",
    "RS": f"(qty - quantile_cont(qty, 0.5) {OVER}) / (quantile_cont(qty, 0.75) {OVER} - quantile_cont(qty, 0.25) {OVER})",
}
# brand shares stand for probabilities: the k-th brand is the k-th scaler
PROBS_SQL = """SELECT k, n / sum(n) OVER ()::DOUBLE AS p FROM (
  SELECT k, sum(p_size)::DOUBLE AS n FROM (SELECT p_size, dense_rank() OVER (ORDER BY p_brand) % 4 AS k FROM part) GROUP BY k)"""


def _probabilities(spark, folder) -> DataFrame:
    """Option probabilities of one feature from the sizes of parts per brand."""
    sums = table(spark, folder, "part").groupBy("p_brand").agg(F.sum("p_size").alias("n"))
    ranked = Grouping.of(sums, []).number(sums, ["p_brand"]).withColumn("k", (F.col("_rn") % 4).cast("int"))
    per_option = ranked.groupBy("k").agg(F.sum("n").cast("double").alias("n"))
    total = per_option.agg(F.sum("n").alias("t"))
    names = F.array(*[F.lit(s) for s in SCALERS])
    shares = Grouping([], None, False, 1).attach(per_option, total)
    return shares.select(
        F.lit("qty").alias("feature"), names[F.col("k")].alias("option"), (F.col("n") / F.col("t")).alias("prob")
    )


@query(
    "mixture_apply",
    f"""WITH p AS ({PROBS_SQL}), w AS (SELECT {", ".join(f"max(CASE WHEN k = {i} THEN p END) AS w{i}" for i in range(4))} FROM p)
    SELECT {IDS}, {sql_rounded(" + ".join(f"w{i} * ({SCALED_SQL[s]})" for i, s in enumerate(SCALERS)))} AS qty
    FROM ({LINE_SQL}) CROSS JOIN w""",
)
def mixture_apply(spark, folder) -> DataFrame:
    rows = lines(spark, folder).select("l_suppkey", *LINE_ID, "qty")
    out = space.mixture(rows, SUPPLIER, ["qty"], [scaler_option(s) for s in SCALERS], _probabilities(spark, folder))
    return out.withColumn("qty", rounded("qty"))


@query(
    "argmax_apply",
    f"""WITH p AS ({PROBS_SQL}), b AS (SELECT k FROM p ORDER BY p DESC, k LIMIT 1)
    SELECT {IDS}, {sql_rounded("CASE k " + " ".join(f"WHEN {i} THEN {SCALED_SQL[s]}" for i, s in enumerate(SCALERS)) + " END")} AS qty
    FROM ({LINE_SQL}) CROSS JOIN b""",
)
def argmax_apply(spark, folder) -> DataFrame:
    rows = lines(spark, folder).select("l_suppkey", *LINE_ID, "qty")
    out = space.mixture(
        rows, SUPPLIER, ["qty"], [scaler_option(s) for s in SCALERS], _probabilities(spark, folder), only_best=True
    )
    return out.withColumn("qty", rounded("qty"))


OPTION_SQL = "SELECT p_brand, p_type, min(p_partkey) AS first, sum(p_size) AS size FROM part GROUP BY p_brand, p_type"


def _option_table(spark, folder) -> DataFrame:
    return table(spark, folder, "part").groupBy("p_brand", "p_type").agg(
        F.min("p_partkey").alias("first"), F.sum("p_size").alias("size")
    )


@query(
    "prob_init",
    f"""SELECT p_brand, p_type, {sql_rounded('''CASE WHEN count(*) OVER b = 1 THEN 1 WHEN p_type = 'ECONOMY' THEN 0.5
      ELSE 0.5 / nullif(count(*) OVER b - 1, 0) END''')} AS prob,
      {sql_rounded("exp(size / 100.0::DOUBLE - max(size) OVER b / 100.0::DOUBLE) / sum(exp(size / 100.0::DOUBLE - m / 100.0::DOUBLE)) OVER b")} AS soft
    FROM (SELECT *, max(size) OVER (PARTITION BY p_brand) AS m FROM ({OPTION_SQL})) WINDOW b AS (PARTITION BY p_brand)""",
)
def prob_init(spark, folder) -> DataFrame:
    """Starting probabilities and softmax of part types per brand."""
    rows = _option_table(spark, folder).withColumn("start", F.col("p_type") == "ECONOMY")
    rows = rows.withColumn("logit", F.col("size") / 100)
    out = space.softmax(space.starting_probabilities(rows, ["p_brand"], "start", 0.5), ["p_brand"], "logit", "soft")
    return out.select("p_brand", "p_type", rounded("prob").alias("prob"), rounded("soft").alias("soft"))


@query(
    "best_config",
    f"""SELECT region, string_agg(p_type, ',' ORDER BY p_brand) AS options FROM (
      SELECT 'all' AS region, p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY size DESC, p_type) AS rn
      FROM ({OPTION_SQL})) WHERE rn = 1 GROUP BY region""",
)
def best_config(spark, folder) -> DataFrame:
    rows = _option_table(spark, folder).select(
        F.lit("all").alias("region"), F.col("p_brand").alias("feature"), F.col("p_brand").alias("feature_no"),
        F.col("p_type").alias("option"), F.col("size").cast("double").alias("prob"), F.col("p_type").alias("position"),
    )
    return space.best_config(rows, ["region"]).withColumn("options", F.concat_ws(",", "options"))


@query("balance_matrix")
def balance_matrix(spark, folder) -> DataFrame:
    """One 3 x 3 matrix per supplier from mean discounts by line number and tax."""
    cells = table(spark, folder, "lineitem").groupBy(
        "l_suppkey", (F.col("l_linenumber") % 3).alias("i"), (F.round(F.col("l_tax") * 100) % 3).cast("int").alias("j")
    )
    return space.balance(cells.agg(F.avg("l_discount").alias("v")), ["l_suppkey"])


@query(
    "grid_candidates",
    f"""WITH c(candidate, weight, shift) AS (VALUES (0, 1, 0), (1, 1, 100), (2, 2, 0), (3, 2, 100), (4, 3, 0), (5, 3, 100)),
    s AS (SELECT l_suppkey, candidate, weight, shift, avg((price / 100 - weight * qty / 100 * 1000 - shift) * (price / 100 - weight * qty / 100 * 1000 - shift)) AS loss
      FROM ({LINE_SQL}) CROSS JOIN c GROUP BY l_suppkey, candidate, weight, shift)
    SELECT l_suppkey, candidate, weight, shift, {sql_rounded("loss", 1)} AS loss FROM (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY loss, candidate) AS rn FROM s) WHERE rn = 1""",
)
def grid_candidates(spark, folder) -> DataFrame:
    """The best of six settings of a price rule per supplier."""

    def loss(p) -> Column:
        error = F.col("price") / 100 - p["weight"] * F.col("qty") / 100 * 1000 - p["shift"]
        return error * error

    out = space.best_candidate(lines(spark, folder), SUPPLIER, {"weight": [1, 2, 3], "shift": [0, 100]}, loss)
    return out.withColumn("loss", rounded("loss", 1))


@query(
    "random_best_of",
    """WITH s AS (SELECT o_custkey % 50 AS grp, CAST(o_orderkey % 50 AS INTEGER) AS seed, min(o_totalprice) AS loss
        FROM orders GROUP BY ALL),
      r AS (SELECT s.grp, k.seeds, s.seed, s.loss, row_number() OVER (PARTITION BY s.grp, k.seeds ORDER BY loss, seed) AS rn
        FROM s JOIN (SELECT grp, seed + 1 AS seeds FROM s WHERE seed + 1 IN (20, 50)) k ON k.grp = s.grp AND s.seed < k.seeds)
    SELECT grp, seeds, seed AS best_seed, loss FROM r WHERE rn = 1""",
)
def random_best_of(spark, folder) -> DataFrame:
    """Best seed after 20 and 50 seeds, from order prices that stand for losses."""
    rows = table(spark, folder, "orders").groupBy(
        (F.col("o_custkey") % 50).alias("grp"), (F.col("o_orderkey") % 50).cast("int").alias("seed")
    )
    return search.best_by_seed(rows.agg(F.min("o_totalprice").alias("loss")), ["grp"], "loss")


@query("random_search")
def random_search(spark, folder) -> DataFrame:
    """Losses of 20 random preparations per supplier, one option per step."""
    return search.random_search(_split_lines(spark, folder), SUPPLIER, FEATURES, TARGET, seeds=20, row_id=LINE_ID)


@query("random_search_best_of")
def random_search_best_of(spark, folder) -> DataFrame:
    """The best of 20 and of 50 random preparations per supplier, by validation loss."""
    found = search.random_search(_split_lines(spark, folder), SUPPLIER, FEATURES, TARGET, seeds=50, row_id=LINE_ID)
    return search.best_by_seed(found, SUPPLIER)


@query("random_search_flexible")
def random_search_flexible(spark, folder) -> DataFrame:
    """Losses of random preparations with an option per step and feature."""
    return search.random_search(_split_lines(spark, folder), SUPPLIER, FEATURES, TARGET, seeds=20, per_feature=True, row_id=LINE_ID)


@query("search_fixed")
def search_fixed(spark, folder) -> DataFrame:
    return search.search_fixed(_split_lines(spark, folder), SUPPLIER, FEATURES, TARGET, LINE_ID)


@query("learned_probabilities")
def learned_probabilities(spark, folder) -> DataFrame:
    """Probabilities of every imputer and scaler per supplier and feature, learned on the validation loss."""
    steps = space.preparation_space(models=True)
    chains = search.fixed_chains(steps, ("missing_value_imputation", "normalization"))
    start = search.default_position(chains, steps)
    found = learn.learn_probabilities(_split_lines(spark, folder), SUPPLIER, FEATURES, TARGET, chains, LINE_ID, start)
    log = learn.probability_log(found, SUPPLIER, FEATURES, chains)
    return log.select("l_suppkey", "feature", "option", rounded("probability", 4).alias("probability"), "chosen")


@query("search_rank_target")
def search_rank_target(spark, folder) -> DataFrame:
    """The search with the dense rank of the price as its target."""
    return search.search_fixed(_split_lines(spark, folder), SUPPLIER, FEATURES, TARGET, LINE_ID, target_as="rank")


@query("search_flexible")
def search_flexible(spark, folder) -> DataFrame:
    return search.search_flexible(_split_lines(spark, folder), SUPPLIER, FEATURES, TARGET, LINE_ID)


@query("search_report")
def search_report(spark, folder) -> DataFrame:
    """How often the search chose each imputer and scaler."""
    found = search.search_fixed(_split_lines(spark, folder), SUPPLIER, FEATURES, TARGET, LINE_ID)
    return reports.option_counts(search.choice_log(found, SUPPLIER))
