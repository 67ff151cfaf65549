"""Exact k nearest donors inside groups, with distances that skip missing coordinates.

The squared distance of two rows is ``D / shared * sum of squared differences`` over the coordinates both rows have.
Groups of at most BLOCK rows are searched in one task each. Larger groups are cut into blocks of donors that have the
same missing pattern and follow the first coordinate. Every query first searches one block, which bounds its k-th
distance; after that it visits only blocks whose bounding box is not farther away. No candidate is left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.plans.grouping import Grouping, spread_by
from cleanloom.plans.ordered import join_on

# donors (and queries) that meet in one task
BLOCK = 20_000
# distances held in memory at once
CELLS = 4_000_000

FOUND = "array<struct<d:double,rn:bigint,v:double>>"


def missing_pattern(columns: Sequence[str]) -> Column:
    """A number with one bit per missing column."""
    return sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(columns)), F.lit(0))


def squared_distances(queries: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """(m, n) squared distances; infinite where two rows share no coordinate."""
    d = queries.shape[1]
    total = np.zeros((len(queries), len(donors)))
    shared = np.zeros_like(total)
    for c in range(d):
        gap = queries[:, c, None] - donors[None, :, c]
        both = ~np.isnan(gap)
        total += np.where(both, gap * gap, 0.0)
        shared += both
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, total * (d / shared), np.inf)


def nearest_positions(distances: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k smallest distances per row, earlier columns first on ties."""
    return np.argsort(distances, axis=1, kind="stable")[:, :k]


def donor_means(values: np.ndarray, train: np.ndarray, k: int) -> np.ndarray:
    """Fill the missing cells of a (n, d) matrix with the mean of the k nearest training rows that have the column.

    Without any usable donor the column mean of the training rows is taken.
    """
    missing = np.isnan(values)
    incomplete = np.flatnonzero(missing.any(axis=1))
    donors = np.flatnonzero(train)
    out = values.copy()
    if not len(incomplete):
        return out
    step = max(1, CELLS // max(1, len(donors)))
    for start in range(0, len(incomplete), step):
        rows = incomplete[start : start + step]
        distances = squared_distances(values[rows], values[donors])
        for c in range(values.shape[1]):
            here = missing[rows, c]
            usable = ~missing[donors, c]
            pool = values[donors[usable], c]
            if not here.any() or not len(pool):
                continue
            gaps = distances[here][:, usable]
            at = nearest_positions(gaps, k)
            near = np.isfinite(np.take_along_axis(gaps, at, axis=1))
            sums = np.where(near, pool[at], 0.0).sum(axis=1)
            counts = near.sum(axis=1)
            out[rows[here], c] = np.where(counts > 0, sums / np.maximum(counts, 1), pool.mean())
    return out


def nearest_means(queries: np.ndarray, donors: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """The mean value of the k nearest donors of each query, earlier ones first on ties; NaN where none shares a coordinate."""
    out = np.full(len(queries), np.nan)
    step = max(1, CELLS // max(1, len(donors)))
    for start in range(0, len(queries) if len(donors) else 0, step):
        distances = squared_distances(queries[start : start + step], donors)
        at = nearest_positions(distances, k)
        near = np.isfinite(np.take_along_axis(distances, at, axis=1))
        counts = near.sum(axis=1)
        sums = np.where(near, values[at], 0.0).sum(axis=1)
        out[start : start + step] = np.where(counts > 0, sums / np.maximum(counts, 1), np.nan)
    return out


def nearest(
    g: Grouping,
    queries: DataFrame,
    donors: DataFrame,
    coordinates: Sequence[str],
    targets: Sequence[str],
    row_id: Sequence[str],
    k: int,
) -> DataFrame:
    """For every query and every target column it lacks, the k nearest donors that have the target.

    Returns keys, row_id, ``_target`` (position in ``targets``) and ``_found`` (distance, donor position, value),
    nearest first. Equal distances follow the donors' order by missing pattern, first coordinate and row id. ``row_id`` must tell the
    rows of a group apart.
    """
    columns = list(dict.fromkeys([*coordinates, *targets]))
    keys = g.keys or ["_all"]
    tie = list(dict.fromkeys([coordinates[0], *row_id]))

    def shaped(rows: DataFrame) -> DataFrame:
        base = rows if g.keys else rows.withColumn("_all", F.lit(0))
        return base.select(
            *keys,
            *row_id,
            *[F.col(c).cast("double").alias(f"_c_{c}") for c in columns],
            missing_pattern(coordinates).alias("_pattern"),
            *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tie)],
        )

    queries, donors = shaped(queries), shaped(donors)
    names = ([f"_c_{c}" for c in coordinates], [f"_c_{c}" for c in targets])
    order = ["_pattern", *[f"_t{i}" for i in range(len(tie))]]
    id_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema if f.name in (*keys, *row_id))
    schema = f"{id_types}, _target int, _found {FOUND}"

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search(left, right, [*keys, *row_id], names, order, k)

    def plain(q: DataFrame, d: DataFrame) -> DataFrame:
        return _meet(q, d, keys, search, schema)

    if g.hot is None:
        found = plain(queries, donors)
    else:
        own = Grouping(keys, g.hot if g.keys else g.hot.withColumn("_all", F.lit(0)), False, g.max_rows)
        (cold_q, hot_q), (cold_d, hot_d) = own.split(queries), own.split(donors)
        found = plain(cold_q, cold_d).unionByName(_blocked(own, hot_q, hot_d, names, order, row_id, schema, k))
    return found if g.keys else found.drop("_all")


def _meet(queries: DataFrame, donors: DataFrame, by: Sequence[str], search, schema: str) -> DataFrame:
    # both sides often come from one table; toDF gives the right side columns of its own
    left, right = spread_by(queries, by), spread_by(donors.toDF(*donors.columns), by)
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, schema)


def _matrix(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Columns of doubles as (rows, columns), NULL as NaN."""
    return np.column_stack([table.column(n).to_numpy() for n in names]).astype(float)


def _search(left: pa.Table, right: pa.Table, ids: list[str], names, order: list[str], k: int) -> pa.Table:
    coordinates, targets = names
    by = ["_rn"] if "_rn" in right.column_names else order
    right = right.take(pc.sort_indices(right, [(c, "ascending") for c in by], null_placement="at_start"))
    position = right.column("_rn").to_numpy() if by == ["_rn"] else np.arange(1, len(right) + 1)
    q, d = _matrix(left, coordinates), _matrix(right, coordinates)
    wanted, values = np.isnan(_matrix(left, targets)), _matrix(right, targets)
    parts = []
    step = max(1, CELLS // max(1, len(d)))
    for start in range(0, len(q), step):
        distances = squared_distances(q[start : start + step], d)
        for t in range(len(targets)):
            here = np.flatnonzero(wanted[start : start + step, t])
            usable = np.flatnonzero(~np.isnan(values[:, t]))
            gaps = distances[here][:, usable]
            at = nearest_positions(gaps, k)
            near = np.take_along_axis(gaps, at, axis=1)
            seen = np.isfinite(near)
            donors = usable[at[seen]]
            found = pa.StructArray.from_arrays(
                [
                    pa.array(near[seen], pa.float64()),
                    pa.array(position[donors].astype("int64"), pa.int64()),
                    pa.array(values[donors, t], pa.float64()),
                ],
                names=["d", "rn", "v"],
            )
            ends = pa.array(np.concatenate([[0], np.cumsum(seen.sum(axis=1))]).astype("int32"))
            rows = left.select(ids).take(pa.array(start + here))
            rows = rows.append_column("_target", pa.array(np.full(len(here), t, "int32")))
            parts.append(rows.append_column("_found", pa.ListArray.from_arrays(ends, found)))
    if parts:
        return pa.concat_tables(parts)
    empty = left.select(ids).slice(0, 0).append_column("_target", pa.array([], pa.int32()))
    kind = pa.list_(pa.struct([("d", pa.float64()), ("rn", pa.int64()), ("v", pa.float64())]))
    return empty.append_column("_found", pa.array([], kind))


def _blocked(g: Grouping, queries, donors, names, order, row_id, schema, k) -> DataFrame:
    coordinates, targets = names
    keys, ids = g.keys, [*g.keys, *row_id]

    # queries take a place among the complete donors, so that their first block is near
    members = donors.withColumn("_kind", F.lit(0)).unionByName(
        queries.withColumn("_pattern", F.lit(0)).withColumn("_kind", F.lit(1))
    )
    placed = g.number(members, [*order, "_kind"]).withColumn("_block", F.expr(f"(_rn - 1) div {BLOCK}"))
    box = [*keys, "_pattern", "_block"]
    homes = placed.where(F.col("_kind") == 1)
    pool = placed.where(F.col("_kind") == 0)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search(left, right, ids, names, order, k)

    first = _meet(homes, pool, box, search, schema)

    # the k-th distance so far, per query and target; unknown counts as infinite
    reach = first.select(*ids, "_target", F.when(F.size("_found") == k, F.element_at("_found", -1)["d"]).alias("_reach"))
    widest = reach.groupBy(*ids).agg(
        F.when(F.count("_reach") == F.count(F.lit(1)), F.max("_reach")).alias("_reach")
    )
    asked = join_on(homes.withColumnsRenamed({"_pattern": "_home_pattern", "_block": "_home"}), widest, ids, "inner")
    boxes = pool.groupBy(*box).agg(
        *[f(c).alias(f"{n}{i}") for i, c in enumerate(coordinates) for f, n in ((F.min, "_lo"), (F.max, "_hi"))]
    )
    # many queries meet many boxes of their group: its boxes are copied once per share of its queries
    shares = queries.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_shares"))
    asked = g.attach(asked, shares).withColumn("_share", F.pmod(F.xxhash64(*row_id), F.col("_shares"))).drop("_shares")
    boxes = g.attach(boxes, shares).withColumn(
        "_share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_shares") - 1))
    ).drop("_shares")
    visits = join_on(asked, boxes, [*keys, "_share"], "inner").where(
        ((F.col("_pattern") != F.col("_home_pattern")) | (F.col("_block") != F.col("_home")))
        & _can_help(coordinates)
        & (_supplies(coordinates, targets))
    )
    visits = visits.select(*row_id, *box, *list(dict.fromkeys([*coordinates, *targets])))
    # many queries may visit one box: they are sliced, and the box's donors copied once per slice
    slices = visits.groupBy(*box).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_slices"))
    sliced_q = join_on(visits, slices, box, "inner").withColumn(
        "_slice", F.pmod(F.xxhash64(*row_id), F.col("_slices"))
    )
    sliced_d = join_on(pool, slices, box, "inner").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_slices") - 1))
    )
    more = _meet(sliced_q, sliced_d, [*box, "_slice"], search, schema)
    # each visited box gives up to k entries; the k nearest are kept before any list is built
    one = [*ids, "_target"]
    entries = first.unionByName(more).select(*one, F.explode_outer("_found").alias("_entry"))
    nearer = Window.partitionBy(*one).orderBy(F.col("_entry").asc_nulls_last())
    best = entries.withColumn("_place", F.row_number().over(nearer)).where(F.col("_place") <= k)
    return best.groupBy(*one).agg(F.array_sort(F.collect_list("_entry")).alias("_found"))


def _can_help(coordinates: Sequence[str]) -> Column:
    """Whether a box can hold a donor at most as far as the query's reach."""
    gaps, shared = F.lit(0.0), F.lit(0)
    for i, c in enumerate(coordinates):
        known = F.col(c).isNotNull() & F.col(f"_lo{i}").isNotNull()
        gap = F.greatest(F.col(f"_lo{i}") - F.col(c), F.col(c) - F.col(f"_hi{i}"), F.lit(0.0))
        gaps = gaps + F.when(known, gap * gap).otherwise(0.0)
        shared = shared + F.when(known, 1).otherwise(0)
    least = gaps * F.lit(float(len(coordinates))) / F.nullif(shared, F.lit(0))
    # the small slack keeps rounding from cutting off an equal distance
    return (shared > 0) & (F.col("_reach").isNull() | (least <= F.col("_reach") * (1 + 1e-9)))


def _supplies(coordinates: Sequence[str], targets: Sequence[str]) -> Column:
    """Whether the donors of a box have any target the query lacks."""
    out = F.lit(False)
    for t in targets:
        has = F.col(f"_lo{coordinates.index(t)}").isNotNull() if t in coordinates else F.lit(True)
        out = out | (F.col(t).isNull() & has)
    return out
