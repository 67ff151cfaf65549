"""Inputs of the queries, derived from the given tables, each as DataFrame and as SQL.

Money and rates are taken in hundredths: sums of whole numbers are exact, so results do not depend on the order in
which tasks add them up. Missing cells and random orders come from integer arithmetic that both engines share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.queries.registry import table

EVENT_ORDER = ["ts"]
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey"]
LINE_VALUES = ["qty", "price", "disc", "tax"]

LINE_SQL = """
  SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_returnflag,
         round(l_quantity * 100) AS qty, round(l_extendedprice * 100) AS price,
         round(l_discount * 100) AS disc, round(l_tax * 100) AS tax,
         (l_orderkey * 31 + l_linenumber * 7 + l_partkey) % 5 <> 0 AS is_train
  FROM lineitem"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as one series per supplier."""
    rows = table(spark, folder, "lineitem")
    hundredths = {"qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax"}
    return rows.select(
        "l_suppkey",
        *LINE_ORDER,
        "l_returnflag",
        *[F.round(F.col(c) * 100).alias(n) for n, c in hundredths.items()],
        ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7 + F.col("l_partkey")) % 5 != 0).alias("is_train"),
    )


def line_draw(i: int, modulus: int = 100) -> Column:
    """A repeatable number 0..modulus-1 per order line for the i-th column."""
    n = F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31 + 13 * i
    return n % modulus


def line_draw_sql(i: int, modulus: int = 100) -> str:
    return f"((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31 + {13 * i}) % {modulus})"


GAPPY_SQL = (
    "SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_returnflag, is_train, "
    + ", ".join(
        f"CASE WHEN {line_draw_sql(i)} >= 5 THEN {c} END AS {c}" for i, c in enumerate(LINE_VALUES, start=1)
    )
    + f" FROM ({LINE_SQL})"
)


def gappy_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``lines`` with about 5 % missing cells per value column."""
    rows = lines(spark, folder)
    return rows.withColumns({c: F.when(line_draw(i) >= 5, F.col(c)) for i, c in enumerate(LINE_VALUES, start=1)})


def line_shuffle(i: int = 0) -> list[Column | str]:
    """A random order of order lines with a total tie-break."""
    mixed = F.col("l_orderkey") * 2654435761 + F.col("l_linenumber") * 40503 + F.col("l_partkey") * 97 + 7919 * i
    return [mixed % 1000003, *LINE_ID]


def line_shuffle_sql(i: int = 0) -> str:
    mixed = f"(l_orderkey * 2654435761 + l_linenumber * 40503 + l_partkey * 97 + {7919 * i}) % 1000003"
    return f"{mixed}, l_orderkey, l_linenumber, l_partkey"


EVENT_SQL = "SELECT event_id, ts, user_id, event_type, round(value * 100) AS amount FROM events"


def user_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as one short series per user."""
    return table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "event_type", F.round(F.col("value") * 100).alias("amount")
    )


def event_shuffle(i: int = 0) -> list[Column | str]:
    return [(F.col("event_id") * 2654435761 + 7919 * i) % 1000003, "event_id"]


def event_shuffle_sql(i: int = 0) -> str:
    return f"(event_id * 2654435761 + {7919 * i}) % 1000003, event_id"


GAPPY_EVENT_SQL = f"""
  SELECT event_id, ts, user_id, event_type, CASE WHEN (event_id * 7919 + 13) % 100 >= 5 THEN amount END AS amount
  FROM ({EVENT_SQL})"""


def gappy_events(spark: SparkSession, folder: str) -> DataFrame:
    return user_events(spark, folder).withColumn(
        "amount", F.when((F.col("event_id") * 7919 + 13) % 100 >= 5, F.col("amount"))
    )
