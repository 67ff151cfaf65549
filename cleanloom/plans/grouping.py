"""Group-wise work that stays balanced when one group holds a large share of all rows.

``Grouping`` knows the key columns and which keys are *hot* (more than ``max_rows`` rows). One count over the key
columns finds them. Without hot keys every method is the plain aggregate, join or window; with hot keys their rows
take a path that never puts a whole group in one task. A grouping whose groups have a fixed size, such as fixed-width
partitions of a series, is declared ``bounded`` and needs no count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cleanloom.plans.ordered import join_on, running_total
from cleanloom.plans.stats import Stat, cut_step
from cleanloom.session import cut

# rows one task may sort for one group; about 200 MB of narrow rows
MAX_GROUP_ROWS = 2_000_000

# with at most this many groups, or hot groups, a table of one row per group is sent to every task
FEW_GROUPS = 100_000

# rows of small groups that a call in a task works on together
TOGETHER_ROWS = 20_000


class Grouping:
    def __init__(
        self,
        keys: Sequence[str],
        hot: DataFrame | None,
        bounded: bool,
        max_rows: int,
        only_hot: bool = False,
        cut_stats: bool = False,
        few: bool = False,
        few_hot: bool = True,
    ):
        self.keys = list(keys)
        self.hot = hot
        self.is_bounded = bounded
        self.max_rows = max_rows
        self.only_hot = only_hot
        self.cut_stats = cut_stats
        self.few = few
        self.few_hot = few_hot

    @classmethod
    def of(cls, df: DataFrame, keys: Sequence[str], max_rows: int | None = None) -> Grouping:
        """Count the rows per key; remember the hot keys (at most ``rows / max_rows``) and whether groups are few."""
        max_rows = max_rows or MAX_GROUP_ROWS
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        seen = counts.agg(F.count(F.lit(1)).alias("groups"), F.max("_n").alias("largest")).first()
        hot = cut(counts.where(F.col("_n") > max_rows)) if (seen["largest"] or 0) > max_rows else None
        few_hot = hot is None or seen["groups"] <= FEW_GROUPS or hot.count() <= FEW_GROUPS
        return cls(keys, hot, False, max_rows, few=seen["groups"] <= FEW_GROUPS, few_hot=few_hot)

    @classmethod
    def bounded(cls, keys: Sequence[str]) -> Grouping:
        """Groups whose size the caller has fixed."""
        return cls(keys, None, True, MAX_GROUP_ROWS)

    # -- rows ---------------------------------------------------------------------------------------------------

    def split(self, df: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """Rows of ordinary groups and rows of hot groups."""
        if self.hot is None:
            return df, None
        if not self.keys or self.only_hot:
            return None, df
        return (
            join_on(df, self.hot.select(*self.keys), self.keys, "left_anti", small=self.few_hot),
            join_on(df, self.hot.select(*self.keys), self.keys, "left_semi", small=self.few_hot),
        )

    def _both(self, df: DataFrame, plain: Callable, spread: Callable) -> DataFrame:
        cold, hot = self.split(df)
        parts = ([plain(cold)] if cold is not None else []) + ([spread(hot)] if hot is not None else [])
        return reduce(DataFrame.unionByName, parts)

    def each(self, df: DataFrame, work: Callable[[DataFrame, Grouping], DataFrame]) -> DataFrame:
        """Run work of several fitting passes once on the rows of ordinary groups and once on those of hot groups.

        With few groups each pass writes its statistics and sends them to every task; the rows are never shuffled.
        With many groups the ordinary ones meet once by key and keep that partitioning through all passes, and only
        hot groups take the first way.
        """
        if self.is_bounded or self.cut_stats:
            return work(df, self)
        if not self.keys or self.few:
            return work(df, Grouping(self.keys, self.hot, False, self.max_rows, cut_stats=True, few=self.few, few_hot=self.few_hot))
        cold, hot = self.split(df)
        out = work(cold, Grouping.bounded(self.keys))
        if hot is None:
            return out
        spread = Grouping(self.keys, self.hot, False, self.max_rows, only_hot=True, cut_stats=True, few_hot=self.few_hot)
        return out.unionByName(work(hot, spread))

    # -- statistics ---------------------------------------------------------------------------------------------

    def stats(self, df: DataFrame, specs: Mapping[str, Stat]) -> DataFrame:
        """One row per group: the key columns and one column per statistic."""

        def plain(rows: DataFrame) -> DataFrame:
            found = rows.groupBy(*self.keys).agg(*[s.aggregate().alias(n) for n, s in specs.items()])
            return found.select(*self.keys, *[s.finish(F.col(n)).alias(n) for n, s in specs.items()])

        def spread(rows: DataFrame) -> DataFrame:
            light = [s.aggregate().alias(n) for n, s in specs.items() if not s.needs_sorted_values]
            out = rows.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_rows"), *light)
            for name, s in specs.items():
                if s.needs_sorted_values:
                    found = self._sorted_stat(rows, name, s)
                    # one row per hot key on both sides
                    out = join_on(out, found, self.keys, "left", small=self.few_hot) if self.keys else _beside(out, found)
            # no value at all gives an empty list of cuts on the plain path
            empty = {n: F.coalesce(F.col(n), F.array()) for n, s in specs.items() if s.kind == "cuts"}
            return out.withColumns(empty).select(*self.keys, *specs)

        return self._both(df, plain, spread)

    def _sorted_stat(self, rows: DataFrame, name: str, s: Stat) -> DataFrame:
        """Mode or exact quantiles of hot groups from counts per distinct value, which no single task holds."""
        values = (
            rows.select(*self.keys, s.column.alias("_v"))
            .where(F.col("_v").isNotNull())
            .groupBy(*self.keys, "_v")
            .agg(F.count(F.lit(1)).alias("_w"))
        )
        if s.kind == "mode":
            best = F.min_by("_v", F.struct((-F.col("_w")).alias("w"), F.col("_v").alias("v")))
            return values.groupBy(*self.keys).agg(best.alias(name))
        placed = running_total(values, self.keys, ["_v"], self.max_rows, weight="_w")
        first = F.col("_upto") - F.col("_w")
        if s.kind == "cuts":
            step = cut_step(F.col("_total"), s.bins)
            # multiples of step among the ranks this value covers, the last rank of the group excluded
            hits = F.floor(F.least(F.col("_upto"), F.col("_total") - 1) / step) - F.floor(first / step)
            return (
                placed.where(hits > 0)
                .select(*self.keys, F.explode(F.array_repeat("_v", hits.cast("int"))).alias("_v"))
                .groupBy(*self.keys)
                .agg(F.array_sort(F.collect_list("_v")).alias(name))
            )
        picked, blended = [], []
        for i, share in enumerate(s.shares):
            at = F.lit(share) * (F.col("_total") - 1)
            for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
                picked.append(F.max(F.when((first <= rank) & (rank < F.col("_upto")), F.col("_v"))).alias(f"{side}{i}"))
            at = F.lit(share) * (F.col("_n") - 1)
            low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
            blended.append(
                F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
            )
        return (
            placed.groupBy(*self.keys)
            .agg(F.max("_total").alias("_n"), *picked)
            .select(*self.keys, F.array(*blended).alias(name))
        )

    def _cut_mark(self, s: Stat) -> Column:
        """The value where it is a cut point of its group, else NULL; so that no row carries all values of a group."""
        group = Window.partitionBy(*self.keys)
        n = F.count(s.column).over(group)
        place = F.row_number().over(group.orderBy(s.column.asc_nulls_last()))
        return F.when((place % cut_step(n, s.bins) == 0) & (place < n), s.column)

    def attach(self, df: DataFrame, stats: DataFrame) -> DataFrame:
        """Add the columns of ``stats`` (one row per group) to every row."""
        if not self.keys:
            return _beside(df, stats)
        if self.few:
            return join_on(df, stats, self.keys, "left", small=True)

        def spread(rows: DataFrame) -> DataFrame:
            few = join_on(stats, self.hot.select(*self.keys), self.keys, "left_semi", small=self.few_hot)
            return join_on(rows, few, self.keys, "left", small=self.few_hot)

        return self._both(df, lambda rows: join_on(rows, stats, self.keys, "left"), spread)

    def with_stats(self, df: DataFrame, specs: Mapping[str, Stat]) -> DataFrame:
        """Add statistics of the row's group to every row."""
        if not specs:
            return df
        if self.is_bounded:
            # the rows of a bounded group already have to meet in one task, so no second shuffle and no join
            group = Window.partitionBy(*self.keys)
            sorted_cuts = {n: s for n, s in specs.items() if s.kind == "cuts"}
            marked = df.select("*", *[self._cut_mark(s).alias(f"_mark_{n}") for n, s in sorted_cuts.items()])
            found = marked.select(
                "*",
                *[
                    (F.collect_list(f"_mark_{n}") if n in sorted_cuts else s.aggregate()).over(group).alias(n)
                    for n, s in specs.items()
                ],
            )
            cuts = {n: F.array_sort(n) for n in sorted_cuts}
            return found.withColumns(cuts).drop(*[f"_mark_{n}" for n in cuts]) if cuts else found
        stats = self.stats(df, specs)
        return self.attach(df, cut(stats) if self.cut_stats else stats)

    # -- order --------------------------------------------------------------------------------------------------

    def number(self, df: DataFrame, order_by: Sequence[str | Column], rn: str = "_rn", n: str = "_n") -> DataFrame:
        """Add the 1-based position of the row in its group and the size of the group."""
        named, names, extra = _named_order(df, order_by)

        def plain(rows: DataFrame) -> DataFrame:
            ordered = Window.partitionBy(*self.keys).orderBy(*names)
            # the size is taken over the same ordered window, so both come from one pass over the group
            whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            return rows.select(
                "*",
                F.row_number().over(ordered).cast("bigint").alias(rn),
                F.count(F.lit(1)).over(whole).alias(n),
            )

        def spread(rows: DataFrame) -> DataFrame:
            placed = running_total(rows, self.keys, names, self.max_rows)
            return placed.withColumnsRenamed({"_upto": rn, "_total": n})

        return self._both(named, plain, spread).drop(*extra)

    def over_rows(
        self,
        df: DataFrame,
        order_by: Sequence[str | Column],
        before: int,
        after: int,
        build: Callable[[DataFrame, WindowSpec], DataFrame],
    ) -> DataFrame:
        """Add window columns that look at most ``before`` rows back and ``after`` rows ahead. ``build`` gets the rows
        and the ordered window of a group, and returns the rows with its columns added.

        Hot groups are cut into blocks of consecutive rows; each block also gets copies of its neighbours' edge rows,
        which are dropped after the window has run.
        """
        named, names, extra = _named_order(df, order_by)

        def plain(rows: DataFrame) -> DataFrame:
            ordered = Window.partitionBy(*self.keys).orderBy(*names)
            return build(rows, ordered)

        def spread(rows: DataFrame) -> DataFrame:
            size = max(self.max_rows, before, after)
            placed = running_total(rows, self.keys, names, self.max_rows).withColumn("_at", F.col("_upto") - 1)
            block, offset = F.expr(f"_at div {size}"), F.col("_at") % size
            homes = F.array_compact(
                F.array(
                    F.struct(block.alias("block"), F.lit(True).alias("own")),
                    F.when(offset >= size - before, F.struct((block + 1).alias("block"), F.lit(False).alias("own"))),
                    F.when(offset < after, F.struct((block - 1).alias("block"), F.lit(False).alias("own"))),
                )
            )
            copies = placed.withColumn("_home", F.explode(homes)).withColumn("_block", F.col("_home.block"))
            ordered = Window.partitionBy(*self.keys, "_block").orderBy("_at")
            return (
                build(copies, ordered)
                .where(F.col("_home.own"))
                .drop("_upto", "_total", "_at", "_home", "_block")
            )

        return self._both(named, plain, spread).drop(*extra)

    def rank(self, df: DataFrame, value: str, ties: str = "average", out: str = "rank") -> DataFrame:
        """Rank by ``value`` inside the group: tied rows share the average ("average") or the smallest ("min") rank.
        Rows without a value get no rank."""
        if ties not in ("average", "min"):
            raise ValueError("ties must be 'average' or 'min'")

        def plain(rows: DataFrame) -> DataFrame:
            group = Window.partitionBy(*self.keys)
            place = F.rank().over(group.orderBy(F.col(value).asc_nulls_last())).cast("double")
            if ties == "average":
                place = place + (F.count(F.lit(1)).over(Window.partitionBy(*self.keys, value)) - 1) / 2
            return rows.select("*", F.when(F.col(value).isNotNull(), place).alias(out))

        def spread(rows: DataFrame) -> DataFrame:
            counts = rows.where(F.col(value).isNotNull()).groupBy(*self.keys, value).agg(F.count(F.lit(1)).alias("_w"))
            placed = running_total(counts, self.keys, [value], self.max_rows, weight="_w")
            place = F.col("_upto") - F.col("_w") + 1
            if ties == "average":
                place = place + (F.col("_w") - 1) / 2
            ranks = placed.select(*self.keys, value, place.cast("double").alias(out))
            return join_on(rows, ranks, [*self.keys, value], "left")

        return self._both(df, plain, spread)


def spread_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring groups together in the configured number of partitions. For costly work per row: adaptive execution would
    merge partitions by their bytes and leave cores idle. Later steps with the same keys need no further shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def groups_together(
    df: DataFrame, keys: Sequence[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, spread: bool = True
) -> DataFrame:
    """Like ``groupBy(keys).applyInArrow(work)``, but ``work`` gets several whole groups at once and the row numbers between
    which they lie, so that what it does per call is shared by small groups. A call holds about TOGETHER_ROWS rows, or those of
    one larger group. ``spread=False`` for rows that already meet by key."""
    if not keys:
        return df.groupBy().applyInArrow(lambda rows: work(rows, np.array([0, len(rows)])), schema)
    placed = (spread_by(df, keys) if spread else df).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(len(b) for b in held) < TOGETHER_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            ends = _group_ends(rows, keys)
            if len(ends) > 2:  # the last group may go on
                yield from work(rows.slice(0, ends[-2]), ends[:-1]).to_batches()
                held = rows.slice(ends[-2]).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield from work(rows, _group_ends(rows, keys)).to_batches()

    return placed.mapInArrow(run, schema)


def _group_ends(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """The row numbers between which rows of one key lie; null is a key of its own, and so is NaN."""
    same = np.ones(len(rows) - 1, bool)
    for k in keys:
        c = rows.column(k)
        if pa.types.is_nested(c.type):
            values = c.to_pylist()
            same &= np.array([a == b for a, b in zip(values[:-1], values[1:], strict=True)], bool)
            continue
        a, b = c.slice(0, len(c) - 1), c.slice(1)
        alike = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        if pa.types.is_floating(c.type):
            alike = pc.or_(alike, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        same &= alike.to_numpy()
    return np.r_[0, np.flatnonzero(~same) + 1, len(rows)]


def grouping(df: DataFrame, keys: Sequence[str] | Grouping) -> Grouping:
    return keys if isinstance(keys, Grouping) else Grouping.of(df, keys)


def _beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the single row of an ungrouped aggregate next to every row."""
    keyed = one_row.withColumn("_r_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(keyed), F.col("_one") == F.col("_r_one"), "left").drop(
        "_one", "_r_one"
    )


def _named_order(df: DataFrame, order_by: Sequence[str | Column]) -> tuple[DataFrame, list[str], list[str]]:
    """Give order expressions names, so that every path sorts by plain columns."""
    names, extra = [], []
    for i, o in enumerate(order_by):
        if isinstance(o, str):
            names.append(o)
        else:
            df = df.withColumn(f"_order{i}", o)
            names.append(f"_order{i}")
            extra.append(f"_order{i}")
    return df, names, extra
