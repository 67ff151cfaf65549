"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to node, label: the smallest node that can be reached.

    Each round hangs the larger neighbours of a node on the smallest node near it, then the smaller ones. The edge
    table never grows beyond a row for each edge, smallest neighbours are found by sums before the shuffle, and the
    number of rounds grows with the logarithm of the nodes. It ends when a round changes nothing.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = cut(now), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(low, F.col("a") == F.col("n"))
        now = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct())
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
