"""Queries on ordered series: features, partitions, splits, injected gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.operators import cleanse, features, inject, partitions
from cleanloom.queries.inputs import (
    EVENT_ORDER,
    EVENT_SQL,
    GAPPY_SQL,
    LINE_ID,
    LINE_ORDER,
    LINE_SQL,
    event_shuffle,
    event_shuffle_sql,
    gappy_lines,
    line_draw,
    line_draw_sql,
    line_shuffle,
    line_shuffle_sql,
    lines,
    user_events,
)
from cleanloom.queries.registry import query, rounded, sql_rounded, table

USER = ["user_id"]
SUPPLIER = ["l_suppkey"]
LINE_WINDOW = "PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey"


def _rolling_sql(column: str, name: str, k: int, function: str, window: str) -> str:
    frame = f"({window} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    value = sql_rounded(f"{function}({column}) OVER {frame}", 4)
    return f"CASE WHEN count({column}) OVER {frame} = {k} THEN {value} END AS {name}"


EVENT_MEANS, EVENT_STDS = {"day_5": 5, "day_10": 10}, {"std_5": 5}
LINE_MEANS, LINE_STDS = {"day_5": 5, "day_30": 30, "day_365": 365}, {"std_5": 5, "std_365": 365}


@query(
    "rolling_features",
    "SELECT event_id, user_id, "
    + ", ".join(
        [_rolling_sql("amount", n, k, "avg", "PARTITION BY user_id ORDER BY ts") for n, k in EVENT_MEANS.items()]
        + [_rolling_sql("amount", n, k, "stddev_samp", "PARTITION BY user_id ORDER BY ts") for n, k in EVENT_STDS.items()]
    )
    + f" FROM ({EVENT_SQL})",
)
def rolling_features(spark, folder) -> DataFrame:
    rows = user_events(spark, folder)
    out = features.rolling_features(rows, USER, EVENT_ORDER, "amount", EVENT_MEANS, EVENT_STDS)
    return out.select("event_id", "user_id", *[rounded(c, 4).alias(c) for c in (*EVENT_MEANS, *EVENT_STDS)])


@query(
    "rolling_features_long",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(
        [_rolling_sql("price", n, k, "avg", LINE_WINDOW) for n, k in LINE_MEANS.items()]
        + [_rolling_sql("price", n, k, "stddev_samp", LINE_WINDOW) for n, k in LINE_STDS.items()]
    )
    + f" FROM ({LINE_SQL})",
)
def rolling_features_long(spark, folder) -> DataFrame:
    rows = lines(spark, folder).select("l_suppkey", *LINE_ORDER, "price")
    out = features.rolling_features(rows, SUPPLIER, LINE_ORDER, "price", LINE_MEANS, LINE_STDS)
    return out.select("l_suppkey", *LINE_ID, *[rounded(c, 4).alias(c) for c in (*LINE_MEANS, *LINE_STDS)])


@query(
    "rolling_features_gaps",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, "
    + _rolling_sql("qty", "day_5", 5, "avg", LINE_WINDOW)
    + f" FROM ({GAPPY_SQL})",
)
def rolling_features_gaps(spark, folder) -> DataFrame:
    """A missing cell makes every window that covers it missing."""
    rows = gappy_lines(spark, folder)
    out = features.rolling_features(rows, SUPPLIER, LINE_ORDER, "qty", {"day_5": 5}, {})
    return out.select("l_suppkey", *LINE_ID, rounded("day_5", 4).alias("day_5"))


@query(
    "lead_horizon",
    f"""SELECT * FROM (
      SELECT event_id, user_id, amount,
             lead(amount, 1) OVER w AS amount_shifted_1, lead(amount, 2) OVER w AS amount_shifted_2,
             lead(amount, 3) OVER w AS amount_shifted_3
      FROM ({EVENT_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    WHERE amount_shifted_3 IS NOT NULL""",
)
def lead_horizon(spark, folder) -> DataFrame:
    rows = user_events(spark, folder).drop("event_type")
    return features.lead_horizon(rows, USER, EVENT_ORDER, ["amount"], 3).drop("ts")


@query(
    "rank_ties",
    f"""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, qty,
      CAST(rank() OVER (PARTITION BY l_suppkey ORDER BY qty) AS DOUBLE) AS rank_min,
      rank() OVER (PARTITION BY l_suppkey ORDER BY qty) + (count(*) OVER (PARTITION BY l_suppkey, qty) - 1) / 2.0::DOUBLE
        AS rank_avg
    FROM ({LINE_SQL})""",
)
def rank_ties(spark, folder) -> DataFrame:
    from cleanloom.plans.grouping import Grouping

    rows = lines(spark, folder).select("l_suppkey", *LINE_ID, "qty")
    by = Grouping.of(rows, SUPPLIER)
    return features.rank_within(features.rank_within(rows, by, "qty", "min", "rank_min"), by, "qty", "average", "rank_avg")


# -- partitions -----------------------------------------------------------------------------------------------------


def _partition_sql(rows: str, columns: str, width: str, step: str, short: bool = False) -> str:
    last = f"CAST(floor(r / ({step})) AS BIGINT)"
    if not short:
        last = f"least({last}, CAST(floor((n - {width}) / ({step})) AS BIGINT))"
    first = f"greatest(0, CAST(ceil((r - {width} + 1) / ({step})) AS BIGINT))"
    return f"""SELECT {columns}, unnest(generate_series({first}, {last})) AS partition_id, r AS series_row
    FROM (SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS r, count(*) OVER (PARTITION BY {rows.split('|')[0]}) AS n
          FROM ({rows.split('|')[2]}) WINDOW w AS (PARTITION BY {rows.split('|')[0]} ORDER BY {rows.split('|')[1]}))"""


EVENT_ROWS = f"user_id|ts|{EVENT_SQL}"
LINE_ROWS = f"l_suppkey|l_shipdate, l_orderkey, l_linenumber, l_partkey|{LINE_SQL}"


@query("partitions_full", _partition_sql(EVENT_ROWS, "event_id, user_id, amount", "40", "10"))
def partitions_full(spark, folder) -> DataFrame:
    out = partitions.row_partitions(user_events(spark, folder), USER, EVENT_ORDER, 40, 10)
    return out.select("event_id", "user_id", "amount", "partition_id", "series_row")


@query("partitions_full_long", _partition_sql(LINE_ROWS, "l_suppkey, l_orderkey, l_linenumber, l_partkey, price", "400", "100"))
def partitions_full_long(spark, folder) -> DataFrame:
    rows = lines(spark, folder).select("l_suppkey", *LINE_ORDER, "price")
    return partitions.row_partitions(rows, SUPPLIER, LINE_ORDER, 400, 100).drop("l_shipdate")


@query("partitions_all", _partition_sql(EVENT_ROWS, "event_id, user_id, amount", "40", "10", short=True))
def partitions_all(spark, folder) -> DataFrame:
    out = partitions.row_partitions(user_events(spark, folder), USER, EVENT_ORDER, 40, 10, keep_short=True)
    return out.select("event_id", "user_id", "amount", "partition_id", "series_row")


@query(
    "partitions_sized",
    _partition_sql(EVENT_ROWS, "event_id, user_id, amount", "floor(n / 2)", "greatest(1, floor(n / 4))"),
)
def partitions_sized(spark, folder) -> DataFrame:
    out = partitions.sized_partitions(user_events(spark, folder), USER, EVENT_ORDER, 3)
    return out.select("event_id", "user_id", "amount", "partition_id", "series_row")


@query(
    "full_series_warm",
    f"""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(0 AS BIGINT) AS partition_id
    FROM (SELECT *, row_number() OVER ({LINE_WINDOW}) AS rn FROM ({LINE_SQL})) WHERE rn > 365""",
)
def full_series_warm(spark, folder) -> DataFrame:
    """The unpartitioned run: warm-up rows dropped, one partition per series."""
    rows = lines(spark, folder).select("l_suppkey", *LINE_ORDER)
    return partitions.whole_series(cleanse.skip_warmup(rows, SUPPLIER, LINE_ORDER, 365)).drop("l_shipdate")


# -- splits ---------------------------------------------------------------------------------------------------------

_SHUFFLED_EVENTS = f"""
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY {event_shuffle_sql()}) AS rn,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM ({EVENT_SQL})"""


@query(
    "holdout_split",
    f"""SELECT event_id, user_id, CASE WHEN rn <= round_even(0.2::DOUBLE * n, 0) THEN 'test' ELSE 'train' END AS split
    FROM ({_SHUFFLED_EVENTS})""",
)
def holdout_split(spark, folder) -> DataFrame:
    rows = user_events(spark, folder).select("event_id", "user_id")
    return partitions.hold_out(rows, USER, event_shuffle(), 0.2)


@query(
    "three_way_split",
    f"""SELECT event_id, user_id,
      CASE WHEN rn <= floor(0.2 * n) THEN 'test' WHEN rn <= 2 * floor(0.2 * n) THEN 'val' ELSE 'train' END AS split
    FROM ({_SHUFFLED_EVENTS})""",
)
def three_way_split(spark, folder) -> DataFrame:
    rows = user_events(spark, folder).select("event_id", "user_id")
    return partitions.three_way_split(rows, USER, event_shuffle())


@query(
    "row_subsample",
    f"SELECT event_id, user_id FROM ({_SHUFFLED_EVENTS}) WHERE rn <= round_even(0.3::DOUBLE * n, 0)",
)
def row_subsample(spark, folder) -> DataFrame:
    rows = user_events(spark, folder).select("event_id", "user_id")
    return partitions.subsample(rows, USER, event_shuffle(), 0.3)


@query("random_batch", f"SELECT event_id, user_id FROM ({_SHUFFLED_EVENTS}) WHERE rn <= 20")
def random_batch(spark, folder) -> DataFrame:
    rows = user_events(spark, folder).select("event_id", "user_id")
    return partitions.random_batch(rows, USER, event_shuffle(), 20)


@query(
    "kfold",
    f"""SELECT event_id, user_id, CAST(CASE WHEN r < m * (q + 1) THEN r // (q + 1)
           ELSE m + (r - m * (q + 1)) // greatest(q, 1) END AS INTEGER) AS fold
    FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS r,
                 count(*) OVER (PARTITION BY user_id) // 5 AS q, count(*) OVER (PARTITION BY user_id) % 5 AS m
          FROM ({EVENT_SQL}))""",
)
def kfold(spark, folder) -> DataFrame:
    rows = user_events(spark, folder).select("event_id", "user_id", "ts")
    return partitions.k_fold(rows, USER, EVENT_ORDER, 5).drop("ts")


@query(
    "sample_series",
    """SELECT event_id, user_id FROM events WHERE user_id IN (
      SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY (user_id * 2654435761) % 1000003, user_id LIMIT 10)""",
)
def sample_series(spark, folder) -> DataFrame:
    """All rows of ten randomly chosen series (a sampling operator)."""
    rows = table(spark, folder, "events").select("event_id", "user_id")
    return partitions.sample_series(rows, "user_id", (F.col("user_id") * 2654435761) % 1000003, 10)


# -- injected gaps --------------------------------------------------------------------------------------------------


@query(
    "inject_exact",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, is_train, "
    + ", ".join(
        f"CASE WHEN NOT is_train OR row_number() OVER (PARTITION BY l_suppkey, is_train ORDER BY {line_shuffle_sql(i)})"
        f" > floor(0.1 * count(*) OVER (PARTITION BY l_suppkey, is_train)) THEN {c} END AS {c}"
        for i, c in enumerate(["qty", "price"], start=1)
    )
    + f" FROM ({LINE_SQL})",
)
def inject_exact(spark, folder) -> DataFrame:
    rows = lines(spark, folder).select("l_suppkey", *LINE_ID, "is_train", "qty", "price")
    return inject.drop_cells_exact(
        rows, SUPPLIER, ["qty", "price"], 0.1, LINE_ID, where=F.col("is_train"), order=line_shuffle
    )


@query(
    "inject_bernoulli",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(
        f"CASE WHEN {line_draw_sql(i, 10007)} / 10007.0 >= 0.01 THEN {c} END AS {c}"
        for i, c in enumerate(["qty", "price"], start=1)
    )
    + f" FROM ({LINE_SQL})",
)
def inject_bernoulli(spark, folder) -> DataFrame:
    rows = lines(spark, folder).select("l_suppkey", *LINE_ID, "qty", "price")
    return inject.drop_cells_random(rows, ["qty", "price"], 0.01, LINE_ID, draw=lambda i: line_draw(i, 10007) / 10007.0)


@query(
    "null_extremes",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(
        f"CASE WHEN {c} >= quantile_cont({c}, 0.03) OVER (PARTITION BY l_suppkey)"
        f" AND {c} <= quantile_cont({c}, 0.97) OVER (PARTITION BY l_suppkey) THEN {c} END AS {c}"
        for c in ("qty", "price")
    )
    + f" FROM ({LINE_SQL})",
)
def null_extremes(spark, folder) -> DataFrame:
    rows = lines(spark, folder).select("l_suppkey", *LINE_ID, "qty", "price")
    return inject.null_extremes(rows, SUPPLIER, ["qty", "price"], 0.03)


@query(
    "pending_work",
    f"""SELECT l_suppkey, partition_id FROM (SELECT DISTINCT l_suppkey, partition_id
      FROM ({_partition_sql(LINE_ROWS, "l_suppkey", "400", "100")}))
    WHERE NOT (l_suppkey % 3 = 0 AND partition_id = 0)""",
)
def pending_work(spark, folder) -> DataFrame:
    """Partitions that have no result yet; every third supplier's first partition is done."""
    rows = lines(spark, folder).select("l_suppkey", *LINE_ORDER)
    work = partitions.row_partitions(rows, SUPPLIER, LINE_ORDER, 400, 100).select("l_suppkey", "partition_id").distinct()
    done = table(spark, folder, "supplier").where(F.col("s_suppkey") % 3 == 0).select(
        F.col("s_suppkey").alias("l_suppkey"), F.lit(0).cast("bigint").alias("partition_id")
    )
    return cleanse.pending_work(work, done, ["l_suppkey", "partition_id"])
