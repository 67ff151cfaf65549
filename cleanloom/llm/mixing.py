"""Mixing sources to target weights along a training curriculum."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.llm.common import WORD, small_or_shuffled, unused
from cleanloom.session import cut

#: Weight schedules over training time 0 to 1, as (time, level) knots joined by lines, one for each weight in turn.
#: Light sources come early, heavy ones late; the levels are relative and only shift a source's share in time.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 1.75)))
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: What tells planned documents apart.
UNIT = ("doc_id", "text_hash", "source", "size")


def when_due(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time at which a source has given ``share`` (0 to 1) of its tokens: its integrated schedule, inverted.

    Within a piece the level is a line, so the integral is a parabola and its inverse a root.
    """
    areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(schedule, schedule[1:], strict=False)]
    whole, before = sum(areas), 0.0
    if whole <= 0 or any(x < 0 for _, x in schedule):
        raise ValueError("a schedule needs levels of zero or more, and some above")
    due: Column | None = None
    for ((t0, a), (t1, b)), area in zip(zip(schedule, schedule[1:], strict=False), areas, strict=True):
        if area <= 0:
            continue
        rest = F.greatest(F.lit(0.0), share * whole - before)
        slope = (b - a) / (t1 - t0)
        here = t0 + 2 * rest / (a + F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + 2 * slope * rest)) + 1e-300)
        here = F.least(F.lit(t1), here)
        due = F.when(share * whole <= before + area, here) if due is None else due.when(share * whole <= before + area, here)
        before += area
    return due.otherwise(F.lit(float(schedule[-1][0])))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Targets of sources from ``sizes`` (source, source_size): source, source_size, turn, weight, target.

    Weights go round the sources in code point order, null last. The targets share all sizes by weight; a target
    stops at ``most`` times its source, and what it leaves is shared by weight among the others, until none is above.
    Sources that fill up are those of least size per weight, so one pass in that order finds the common level. The
    table has a row for each source.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    rows = sizes.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("turn") + 1))
    every = Window.partitionBy(F.lit(0))
    filling = every.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(
        "level",
        (F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double")
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    open_ = F.col("level") * F.col("weight") <= most * F.col("source_size")
    level = F.min_by("level", F.when(open_, F.col("source_size") / F.col("weight"))).over(every)
    target = F.least((most * F.col("source_size")).cast("double"), level * F.col("weight"))
    return rows.select("source", "source_size", "turn", "weight", target.alias("target"))


def plan(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, most: int = MOST_REPEATS,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """What the mix takes of every document, and when.

    Rows: doc_id, text_hash, source, n_rows (rows that agree in these three; they are planned together), size
    (words), source_size, target, copies, taken (words, ``copies`` times size), positions (training time of each copy, 0
    to 1).

    In each source, documents stand in the order of their id's md5, round after round: the middle of each copy is a point
    of the source's cumulative demand, and the source's integrated schedule, inverted there, is the copy's position. A
    copy beyond the target has no position and is not taken. The running sums are taken in blocks of that order,
    whose totals are summed apart, so no source is sorted or summed in one task. Null texts have size 0; a null id or
    source is a value of its own. An empty table gives an empty one.
    """
    size = F.coalesce(F.regexp_count(F.col(text_column).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text_column).cast("string")).alias("text_hash"),
        F.col(source_column).cast("string").alias("source"), size.alias("size"),
    )
    units = cut(rows.groupBy("doc_id", "text_hash", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")))
    units = units.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    sources = cut(sources)
    targets = source_targets(sources.select("source", "source_size"), weights, most)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = sources.agg(F.sum("n_units")).first()[0] or 0
    block_rows = min(20_000, max(64, total // (4 * partitions)))
    named = targets.withColumnRenamed("source", "s").join(sources.select(F.col("source").alias("s2"), "n_units"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    units = units.join(small_or_shuffled(named, rows=sources.count()), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    spot = F.conv(F.substring("order", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    units = units.withColumn("block", F.floor(spot * F.ceil(F.col("n_units") / block_rows)))
    words = F.col("size") * F.col("n_rows")
    blocks = cut(units.groupBy("source", "block").agg(F.sum(words).alias("block_size")))
    until = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("block_size").over(until), F.lit(0)).alias("ahead"))
    units = units.join(small_or_shuffled(blocks, 200_000), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    inside = Window.partitionBy("source", "block").orderBy("order", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("at", F.col("ahead") + F.coalesce(F.sum(words).over(inside), F.lit(0)))

    def due(k: Column) -> Column:
        demand = k * F.col("source_size") + F.col("at") + words / 2
        x = demand / F.greatest(F.col("target"), F.lit(1e-9))
        at = when_due(x, schedules[0])
        for turn in range(1, len(weights)):
            at = F.when(F.col("turn") == turn, when_due(x, schedules[turn % len(schedules)])).otherwise(at)
        return F.when((F.col("target") > 0) & (demand <= F.col("target")), at)

    positions = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), due), lambda at: at.isNotNull())
    units = units.withColumn("positions", positions).withColumn("copies", F.size("positions"))
    return units.select(
        "doc_id", "text_hash", "source", "n_rows", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "positions"
    )


def in_order(planned: DataFrame) -> DataFrame:
    """A row for each copy of each planned document that is taken, dealt out by ranges of its position and sorted there.

    Rows that agree stand together: ``n_rows`` says how often a copy is meant.
    """
    copies = planned.select(*UNIT, "n_rows", F.explode("positions").alias("position"))
    return copies.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def placed(planned: DataFrame) -> DataFrame:
    """``planned`` with ``copies``, ``taken`` and ``first_position`` (null if none is taken) read from the sorted copies.

    The copies are written in training order before they are counted, so every position is worked out and sorted.
    """
    planned = cut(planned.drop("copies", "taken"))
    copies = cut(in_order(planned))
    found = copies.groupBy(*[F.col(c).alias(f"_{c}") for c in UNIT]).agg(F.count("position").alias("copies"), F.min("position").alias("first_position"))
    rows = planned.join(found, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in UNIT]), "left").drop(*[f"_{c}" for c in UNIT])
    rows = rows.withColumn("copies", F.coalesce("copies", F.lit(0)).cast("int"))
    return rows.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The documents in training order: every row as often as the mix takes it, range-sorted by ``position``.

    ``position`` is added, with underscores behind it if ``docs`` has such a column; other columns of any name pass
    through. Nulls, repeats and empty tables as :func:`plan` has them.
    """
    planned = plan(docs, id_column=id_column, text_column=text_column, source_column=source_column, **options)
    name, position = unused("planned", docs.columns), unused("position", docs.columns)
    planned = planned.where("copies > 0").select(F.struct("doc_id", "text_hash", "source", "positions").alias(name))
    same = (
        docs[id_column].eqNullSafe(F.col(f"{name}.doc_id"))
        & (F.xxhash64(docs[text_column].cast("string")) == F.col(f"{name}.text_hash"))
        & docs[source_column].cast("string").eqNullSafe(F.col(f"{name}.source"))
    )
    rows = docs.join(planned, same).select(*[docs[c] for c in docs.columns], F.explode(f"{name}.positions").alias(position))
    return rows.repartitionByRange(position, id_column).sortWithinPartitions(position, id_column)
