"""Queries that compare partitions and groups, and that summarise many runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.columns import wall_micros
from cleanloom.operators import partitions, reports, transfer
from cleanloom.queries.inputs import LINE_ORDER, lines
from cleanloom.queries.registry import query, rounded, sql_rounded, table
from cleanloom.queries.series import LINE_ROWS, SUPPLIER, _partition_sql

WIDTH, STEP = 400, 100
PART = ["l_suppkey", "partition_id"]


def _parts(spark, folder) -> DataFrame:
    return partitions.row_partitions(lines(spark, folder), SUPPLIER, LINE_ORDER, WIDTH, STEP)


PARTS_SQL = _partition_sql(LINE_ROWS, "l_suppkey, l_shipdate, l_returnflag, price, n", str(WIDTH), str(STEP))


def _scores(spark, folder) -> DataFrame:
    """A score table: mean price per partition, with the return flag in the place of the cleaning method."""
    rows = _parts(spark, folder)
    return rows.groupBy(*PART, F.lit("mean").alias("model"), F.col("l_returnflag").alias("method")).agg(
        F.avg("price").alias("rmse")
    )


SCORES_SQL = f"""SELECT l_suppkey, partition_id, 'mean' AS model, l_returnflag AS method, avg(price) AS rmse
  FROM ({PARTS_SQL}) GROUP BY l_suppkey, partition_id, l_returnflag"""

MIDS_SQL = f"""SELECT l_suppkey, partition_id, count(*) AS n_rows,
    min(epoch_us(l_shipdate)) + (max(epoch_us(l_shipdate)) - min(epoch_us(l_shipdate))) // 2 AS mid
  FROM ({PARTS_SQL}) GROUP BY l_suppkey, partition_id"""

DISTANCE_SQL = f"""SELECT a.l_suppkey, a.partition_id AS i, b.partition_id AS j,
    CAST(round_even((abs(b.mid - a.mid) // 86400000000) / 10.0::DOUBLE, 0) * 10 AS BIGINT) AS distance,
    CAST(abs(a.n_rows * (a.partition_id + 1) // 2 - b.n_rows * (b.partition_id + 1) // 2) AS BIGINT) AS row_distance
  FROM m a JOIN m b ON a.l_suppkey = b.l_suppkey AND a.partition_id < b.partition_id"""


@query("partition_distance", f"WITH m AS ({MIDS_SQL}) {DISTANCE_SQL}")
def partition_distance(spark, folder) -> DataFrame:
    return transfer.partition_distances(_parts(spark, folder), SUPPLIER, "l_shipdate")


@query(
    "partition_mid_date",
    f"""SELECT l_suppkey, partition_id, epoch_us(l_shipdate) AS midpoint FROM (
      SELECT *, min(series_row) OVER (PARTITION BY l_suppkey, partition_id) AS first FROM ({PARTS_SQL}))
    WHERE series_row = first + {WIDTH // 2}""",
)
def partition_mid_date(spark, folder) -> DataFrame:
    out = transfer.middle_row_time(_parts(spark, folder), PART, "l_shipdate")
    return out.withColumn("midpoint", wall_micros(out, "midpoint"))


@query(
    "score_midpoints",
    f"""WITH s AS ({SCORES_SQL}), d AS (SELECT l_suppkey, partition_id, epoch_us(l_shipdate) AS midpoint FROM (
      SELECT *, min(series_row) OVER (PARTITION BY l_suppkey, partition_id) AS first FROM ({PARTS_SQL}))
      WHERE series_row = first + {WIDTH // 2})
    SELECT s.l_suppkey, s.partition_id, s.method, {sql_rounded("s.rmse", 4)} AS rmse, d.midpoint
    FROM s JOIN d ON s.l_suppkey = d.l_suppkey AND s.partition_id = d.partition_id""",
)
def score_midpoints(spark, folder) -> DataFrame:
    middles = transfer.middle_row_time(_parts(spark, folder), PART, "l_shipdate")
    out = transfer.attach_midpoint(_scores(spark, folder), middles, PART)
    return out.select(*PART, "method", rounded("rmse", 4).alias("rmse"), wall_micros(out, "midpoint").alias("midpoint"))


@query(
    "method_rank_avg",
    f"""WITH s AS ({SCORES_SQL}), f AS (SELECT * REPLACE (CASE WHEN (l_suppkey + partition_id) % 4 = 0 AND method = 'A'
        THEN NULL ELSE rmse END AS rmse) FROM s),
      g AS (SELECT *, coalesce(rmse, max(rmse) OVER (PARTITION BY l_suppkey, partition_id, model) + 1) AS score FROM f)
    SELECT l_suppkey, partition_id, model, method,
      rank() OVER (PARTITION BY l_suppkey, partition_id, model ORDER BY score)
        + (count(*) OVER (PARTITION BY l_suppkey, partition_id, model, score) - 1) / 2.0::DOUBLE AS rank FROM g""",
)
def method_rank_avg(spark, folder) -> DataFrame:
    """Some scores are missing and rank last."""
    missing = ((F.col("l_suppkey") + F.col("partition_id")) % 4 == 0) & (F.col("method") == "A")
    scores = _scores(spark, folder).withColumn("rmse", F.when(~missing, F.col("rmse")))
    return transfer.method_ranks(scores, [*PART, "model"]).drop("rmse")


def _pair_sql(columns: str, rows: str) -> str:
    return f"""SELECT a.l_suppkey, a.model, a.method, a.partition_id AS i, b.partition_id AS j, {columns}
    FROM {rows} a JOIN {rows} b ON a.l_suppkey = b.l_suppkey AND a.model = b.model AND a.method = b.method
      AND a.partition_id < b.partition_id"""


@query(
    "rank_difference",
    f"""WITH r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey, partition_id, model ORDER BY rmse) AS rank
      FROM ({SCORES_SQL})) {_pair_sql("CAST(abs(a.rank - b.rank) AS DOUBLE) AS rank_difference", "r")}""",
)
def rank_difference(spark, folder) -> DataFrame:
    return transfer.rank_difference(_scores(spark, folder), SUPPLIER)


@query(
    "rank_difference_by_distance",
    f"""WITH m AS ({MIDS_SQL}), d AS ({DISTANCE_SQL}),
      r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey, partition_id, model ORDER BY rmse) AS rank FROM ({SCORES_SQL})),
      p AS ({_pair_sql("CAST(abs(a.rank - b.rank) AS DOUBLE) AS rank_difference", "r")})
    SELECT p.*, d.distance, d.row_distance FROM p JOIN d ON p.l_suppkey = d.l_suppkey AND p.i = d.i AND p.j = d.j""",
)
def rank_difference_by_distance(spark, folder) -> DataFrame:
    parts = _parts(spark, folder)
    distances = transfer.partition_distances(parts, SUPPLIER, "l_shipdate")
    return transfer.with_distance(transfer.rank_difference(_scores(spark, folder), SUPPLIER), distances, SUPPLIER)


@query(
    "performance_ratio",
    f"""WITH s AS (SELECT *, min(CASE WHEN rmse > 0 THEN rmse END) OVER (PARTITION BY l_suppkey, partition_id) AS least
      FROM ({SCORES_SQL})) {_pair_sql(sql_rounded("(b.rmse + least(0.001, a.least, b.least)) / (a.rmse + least(0.001, a.least, b.least))") + " AS performance_ratio", "s")}""",
)
def performance_ratio(spark, folder) -> DataFrame:
    out = transfer.performance_ratio(_scores(spark, folder), SUPPLIER)
    return out.withColumn("performance_ratio", rounded("performance_ratio"))


def _placed_scores(spark, folder) -> DataFrame:
    """Scores with the midpoint of their partition."""
    mids = transfer.partition_midpoints(_parts(spark, folder), SUPPLIER, "l_shipdate").select(*PART, "mid")
    return transfer.attach_midpoint(_scores(spark, folder), mids, PART)


@query(
    "performance_ratio_by_distance",
    f"""WITH m AS ({MIDS_SQL}), d AS ({DISTANCE_SQL}),
      s AS (SELECT *, min(CASE WHEN rmse > 0 THEN rmse END) OVER (PARTITION BY l_suppkey, partition_id) AS least FROM ({SCORES_SQL})),
      p AS ({_pair_sql("(b.rmse + least(0.001, a.least, b.least)) / (a.rmse + least(0.001, a.least, b.least)) AS ratio", "s")})
    SELECT p.l_suppkey, p.method, d.distance, {sql_rounded("avg(p.ratio)")} AS performance_ratio, count(*) AS n_pairs
    FROM p JOIN d ON p.l_suppkey = d.l_suppkey AND p.i = d.i AND p.j = d.j GROUP BY p.l_suppkey, p.method, d.distance""",
)
def performance_ratio_by_distance(spark, folder) -> DataFrame:
    """Mean ratio per distance in days: the pairs themselves are not kept."""
    pairs = transfer.performance_ratio(_placed_scores(spark, folder), SUPPLIER, carry=["mid"])
    out = transfer.mean_by_distance(pairs, [*SUPPLIER, "method"], "performance_ratio")
    return out.withColumn("performance_ratio", rounded("performance_ratio"))


@query(
    "rank_average_by_distance",
    f"""WITH m AS ({MIDS_SQL}), d AS ({DISTANCE_SQL}),
      r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey, partition_id, model ORDER BY rmse)
        + (count(*) OVER (PARTITION BY l_suppkey, partition_id, model, rmse) - 1) / 2.0::DOUBLE AS rank FROM ({SCORES_SQL})),
      p AS ({_pair_sql("abs(a.rank - b.rank) AS rank_difference", "r")})
    SELECT p.l_suppkey, p.method, d.distance, {sql_rounded("avg(p.rank_difference)")} AS rank_difference, count(*) AS n_pairs
    FROM p JOIN d ON p.l_suppkey = d.l_suppkey AND p.i = d.i AND p.j = d.j WHERE p.j - p.i <= 3 GROUP BY p.l_suppkey, p.method, d.distance""",
)
def rank_average_by_distance(spark, folder) -> DataFrame:
    """Mean difference of average ranks between partitions at most three steps apart."""
    pairs = transfer.rank_difference(_placed_scores(spark, folder), SUPPLIER, ties="average", max_distance=3, carry=["mid"])
    out = transfer.mean_by_distance(pairs, [*SUPPLIER, "method"], "rank_difference")
    return out.withColumn("rank_difference", rounded("rank_difference"))


@query(
    "rank_average_by_distance_all",
    f"""WITH m AS ({MIDS_SQL}), d AS ({DISTANCE_SQL}),
      r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey, partition_id, model ORDER BY rmse)
        + (count(*) OVER (PARTITION BY l_suppkey, partition_id, model, rmse) - 1) / 2.0::DOUBLE AS rank FROM ({SCORES_SQL})),
      p AS ({_pair_sql("abs(a.rank - b.rank) AS rank_difference", "r")})
    SELECT p.l_suppkey, p.method, d.distance, {sql_rounded("avg(p.rank_difference)")} AS rank_difference, count(*) AS n_pairs
    FROM p JOIN d ON p.l_suppkey = d.l_suppkey AND p.i = d.i AND p.j = d.j GROUP BY p.l_suppkey, p.method, d.distance""",
)
def rank_average_by_distance_all(spark, folder) -> DataFrame:
    """Mean difference of average ranks between all pairs of partitions of a series."""
    pairs = transfer.rank_difference(_placed_scores(spark, folder), SUPPLIER, ties="average", carry=["mid"])
    out = transfer.mean_by_distance(pairs, [*SUPPLIER, "method"], "rank_difference")
    return out.withColumn("rank_difference", rounded("rank_difference"))


@query(
    "abs_diff_ratio",
    f"""WITH s AS ({SCORES_SQL}), t AS (SELECT s.*, n.rmse AS base FROM s JOIN s n ON s.l_suppkey = n.l_suppkey
      AND s.partition_id = n.partition_id AND s.model = n.model AND n.method = 'R')
    {_pair_sql(sql_rounded("(abs(a.rmse - b.rmse) + 0.0001) / (abs(a.base - b.base) + 0.0001)", 4) + " AS abs_diff_ratio", "t")}""",
)
def abs_diff_ratio(spark, folder) -> DataFrame:
    out = transfer.abs_difference_ratio(_scores(spark, folder), SUPPLIER, base_method="R")
    return out.withColumn("abs_diff_ratio", rounded("abs_diff_ratio", 4))


@query(
    "unpivot_scores",
    f"""SELECT l_suppkey, partition_id, model, metric, {sql_rounded('"MSE"', 4)} AS "MSE" FROM (
      SELECT l_suppkey, partition_id, model, m.metric AS metric, max(CASE WHEN method = m.metric THEN rmse END) AS "MSE"
      FROM ({SCORES_SQL}) CROSS JOIN (VALUES ('A'), ('N'), ('R')) m(metric)
      GROUP BY l_suppkey, partition_id, model, m.metric)""",
)
def unpivot_scores(spark, folder) -> DataFrame:
    from cleanloom.sources.files import scores_to_wide

    wide = scores_to_wide(_scores(spark, folder), PART, ["A", "N", "R"])
    return transfer.unpivot_scores(wide, [*PART, "model"], ["A", "N", "R"]).withColumn("MSE", rounded("MSE", 4))


# -- groups ---------------------------------------------------------------------------------------------------------


def _transfer_scores(spark, folder) -> DataFrame:
    """One score per supplier and customer: mean discount, with both named like two series."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_discount") * 100).alias("disc"))
    buyers = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return (
        rows.join(buyers, "l_orderkey")
        .groupBy("l_suppkey", "o_custkey")
        .agg(F.sum("disc").alias("score"))
        .select(
            F.concat(F.lit("S"), "l_suppkey").alias("source"), F.concat(F.lit("C"), "o_custkey").alias("target"), "score"
        )
    )


def _group_names(spark, folder) -> DataFrame:
    """Nation of every supplier and customer; the last of duplicate names wins."""
    suppliers = table(spark, folder, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("name"), F.col("s_nationkey").alias("key")
    )
    customers = table(spark, folder, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("name"), F.col("c_nationkey").alias("key")
    )
    nations = table(spark, folder, "nation")
    return suppliers.union(customers).join(nations, F.col("key") == F.col("n_nationkey")).select(
        "name", F.col("n_name").alias("group")
    )


MAPPED_SQL = """
  g AS (SELECT name, n_name AS grp FROM (SELECT 'S' || s_suppkey AS name, s_nationkey AS k FROM supplier
          UNION ALL SELECT 'C' || c_custkey, c_nationkey FROM customer) JOIN nation ON k = n_nationkey),
  s AS (SELECT 'S' || l_suppkey AS source, 'C' || o_custkey AS target, sum(round(l_discount * 100)) AS score
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, o_custkey),
  mapped AS (SELECT a.grp AS group_i, b.grp AS group_j, score FROM s JOIN g a ON a.name = source JOIN g b ON b.name = target),
  matrix AS (SELECT group_j, group_i, avg(score) AS score FROM (
    SELECT group_j, group_i, score FROM mapped
    UNION ALL SELECT grp, grp, 1.0 FROM (SELECT group_i AS grp FROM mapped UNION SELECT group_j FROM mapped))
    GROUP BY group_j, group_i)"""


@query("group_matrix", f"WITH {MAPPED_SQL} SELECT group_j, group_i, {sql_rounded('score')} AS score FROM matrix")
def group_matrix(spark, folder) -> DataFrame:
    mapped = transfer.map_groups(_transfer_scores(spark, folder), _group_names(spark, folder))
    return transfer.group_matrix(mapped).withColumn("score", rounded("score"))


@query(
    "group_index",
    f"""WITH {MAPPED_SQL}, names AS (SELECT group_i AS grp FROM matrix UNION SELECT group_j FROM matrix),
      idx AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS i FROM names)
    SELECT j.i AS index_j, i.i AS index_i, {sql_rounded('score')} AS score
    FROM matrix JOIN idx j ON j.grp = group_j JOIN idx i ON i.grp = group_i""",
)
def group_index(spark, folder) -> DataFrame:
    mapped = transfer.map_groups(_transfer_scores(spark, folder), _group_names(spark, folder))
    return transfer.indexed_matrix(transfer.group_matrix(mapped)).withColumn("score", rounded("score"))


# -- reports --------------------------------------------------------------------------------------------------------


def _choices(spark, folder) -> DataFrame:
    """One run per twenty parts: their brands and types stand for the options chosen for twenty features."""
    rows = table(spark, folder, "part").select(
        F.floor(F.col("p_partkey") / 20).alias("run"),
        F.struct(F.col("p_partkey").alias("k"), F.col("p_brand").alias("a"), F.col("p_type").alias("b")).alias("cell"),
    )
    listed = rows.groupBy("run").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return listed.select(
        "run",
        F.transform("cells", lambda c: c["a"]).alias("num_tf"),
        F.transform("cells", lambda c: c["b"]).alias("normalization"),
    )


CHOICES_SQL = """SELECT run, list(p_brand ORDER BY p_partkey) AS num_tf,
    list(p_type ORDER BY p_partkey) AS normalization
  FROM (SELECT *, p_partkey // 20 AS run FROM part) GROUP BY run"""


@query(
    "option_counts",
    f"""SELECT step, option, count(*) AS uses FROM (
      SELECT 'num_tf' AS step, unnest(num_tf) AS option FROM ({CHOICES_SQL})
      UNION ALL SELECT 'normalization', unnest(normalization) FROM ({CHOICES_SQL})) GROUP BY step, option""",
)
def option_counts(spark, folder) -> DataFrame:
    return reports.option_counts(_choices(spark, folder))


CHAIN_SQL = """'[' || list_aggregate(list_transform(list_zip(num_tf, normalization),
  lambda x: '{"imputer":"' || x[1] || '","scaler":"' || x[2] || '"}'), 'string_agg', ',') || ']'"""


@query(
    "option_chains",
    f"SELECT chain, count(*) AS runs FROM (SELECT {CHAIN_SQL} AS chain FROM ({CHOICES_SQL})) GROUP BY chain",
)
def option_chains(spark, folder) -> DataFrame:
    return reports.option_chains(_choices(spark, folder))


@query(
    "top_chains",
    f"""SELECT chain, count(*) AS runs FROM (SELECT {CHAIN_SQL} AS chain FROM ({CHOICES_SQL}))
    GROUP BY chain ORDER BY runs DESC, chain LIMIT 5""",
)
def top_chains(spark, folder) -> DataFrame:
    return reports.top_chains(_choices(spark, folder))


@query(
    "top_pairs",
    f"""SELECT imputer, scaler, count(*) AS uses FROM (
      SELECT unnest(num_tf) AS imputer, unnest(normalization) AS scaler FROM ({CHOICES_SQL}))
    GROUP BY imputer, scaler ORDER BY uses DESC, imputer, scaler LIMIT 5""",
)
def top_pairs(spark, folder) -> DataFrame:
    return reports.top_pairs(_choices(spark, folder))


@query(
    "best_of",
    """SELECT o_custkey, best_epoch, best_val_loss, best_tr_loss FROM (
      SELECT o_custkey, o_orderkey AS best_epoch, o_totalprice AS best_val_loss, o_totalprice / 2 AS best_tr_loss,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def best_of(spark, folder) -> DataFrame:
    runs = table(spark, folder, "orders").select(
        "o_custkey",
        F.col("o_orderkey").alias("best_epoch"),
        F.col("o_totalprice").alias("best_val_loss"),
        (F.col("o_totalprice") / 2).alias("best_tr_loss"),
    )
    return reports.best_of(runs, ["o_custkey"], "best_val_loss", ["best_epoch", "best_val_loss", "best_tr_loss"], ["best_epoch"])


@query(
    "result_summary",
    """SELECT o_orderpriority, 'o_totalprice' AS loss, count(*) AS runs, min(o_totalprice) AS min,
      round(median(o_totalprice), 4) AS median, round(avg(o_totalprice), 2) AS mean, max(o_totalprice) AS max
    FROM orders GROUP BY o_orderpriority""",
)
def result_summary(spark, folder) -> DataFrame:
    out = reports.result_summary(table(spark, folder, "orders"), ["o_orderpriority"], ["o_totalprice"])
    return out.withColumns({"mean": F.round("mean", 2), "median": F.round("median", 4)})


OPTIONS_SQL = """SELECT p_brand, p_type, sum(p_size) / sum(sum(p_size)) OVER (PARTITION BY p_brand)::DOUBLE AS prob,
    dense_rank() OVER (ORDER BY p_type) - 1 AS position FROM part GROUP BY p_brand, p_type"""


@query(
    "option_log",
    f"""SELECT p_brand, p_type || ':' || printf('%.2f', prob) AS choice FROM (
      SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY prob DESC, position) AS rn FROM ({OPTIONS_SQL})) WHERE rn = 1""",
)
def option_log(spark, folder) -> DataFrame:
    """Shares of part sizes per brand stand for option probabilities."""
    sums = table(spark, folder, "part").groupBy("p_brand", "p_type").agg(F.sum("p_size").alias("s"))
    totals = sums.groupBy("p_brand").agg(F.sum("s").alias("t"))
    options = sums.join(totals, "p_brand").select(
        "p_brand", F.col("p_type").alias("option"), (F.col("s") / F.col("t")).alias("prob"), F.col("p_type").alias("position")
    )
    return reports.option_log(options, ["p_brand"])
