"""Nearest neighbours from balanced posting lists with replicated borders and a graph over their centres."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.llm.common import map_arrow
from cleanloom.session import cut, ship_package

#: Vectors of a list, on average; numbers in the sample that the index is fitted on; most lists, whose centres are
#: sent to every task; rows of a block, the most that meet in one task.
LIST_SIZE = 160
SAMPLE_VALUES = 4_000_000
#: Cells of a table of distances while the index is fitted (16 MB).
CELLS = 2_000_000
#: Vectors that walk the graph of centres together.
AT_ONCE = 256
MOST_LISTS = 8_192
BLOCK = 4_096


def usable(vector: str) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    x = F.col(vector)
    plain = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & plain & F.exists(x, lambda v: v != 0)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(flat):
        return np.zeros((0, 1))
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances; one table of len(a) x len(b) is made and changed in place."""
    out = a @ b.T
    out *= -2
    out += (a * a).sum(1)[:, None]
    out += (b * b).sum(1)[None]
    return np.maximum(out, 0, out=out)


def parts_of(rows: int, columns: int) -> list[slice]:
    """Slices of so many rows that a table of them by ``columns`` has at most CELLS cells."""
    size = max(1, CELLS // max(1, columns))
    return [slice(at, at + size) for at in range(0, rows, size)]


def balanced_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Means of ``k`` clusters of about equal size: a cluster above the average is made to look further away."""
    rng = np.random.default_rng(0)
    centres = x[rng.choice(len(x), k, replace=False)]
    spread = squares(x[:256], centres).min(axis=1).mean() + 1e-12
    size = np.ones(k)
    for _ in range(rounds):
        heavier = 0.1 * spread * (size - 1)
        nearest = np.concatenate([np.add(gap := squares(x[s], centres), heavier, out=gap).argmin(1) for s in parts_of(len(x), k)])
        count = np.bincount(nearest, minlength=k)
        order = np.argsort(nearest, kind="stable")
        there = np.flatnonzero(count)
        means = np.add.reduceat(x[order], (np.cumsum(count) - count)[there]) / count[there, None]
        centres = centres.copy()
        centres[there] = means
        empty = np.flatnonzero(count == 0)
        if len(empty):  # an empty list takes over a vector of the fullest one
            crowded = np.flatnonzero(nearest == count.argmax())
            centres[empty] = x[rng.choice(crowded, len(empty))]
        size = 0.5 * size + 0.5 * count / max(1e-9, count.mean())
    return centres


class CentreGraph:
    """A graph of near centres, searched from a few entries by keeping the best ``width`` seen."""

    def __init__(self, centres: np.ndarray, degree: int = 16, entries: int = 8):
        self.centres, k = centres, len(centres)
        rng = np.random.default_rng(1)
        near = np.concatenate([np.argpartition(squares(centres[s], centres), min(k - 1, degree), axis=1)[:, : degree + 1] for s in parts_of(k, k)])
        far = rng.integers(0, k, (k, 4))  # a few links at random keep the graph in one piece
        self.links = np.concatenate([near, far], axis=1)
        self.entries = rng.choice(k, min(k, entries), replace=False)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``width`` centres found for each query, nearest first, and their squared distances."""
        n, k = len(queries), len(self.centres)
        width = min(width, k)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, k), bool)
        ids = np.tile(self.entries, (n, 1))
        seen[rows, ids] = True
        gap = ((queries[:, None] - self.centres[ids]) ** 2).sum(-1)
        done = np.zeros(ids.shape, bool)
        while True:
            open_gap = np.where(done, np.inf, gap)
            best = np.argsort(open_gap, axis=1)[:, :4]
            live = np.isfinite(open_gap[rows, best])
            if not live.any():
                break
            done[rows, best] |= live
            new = np.where(live[..., None], self.links[ids[rows, best]], ids[rows, best][..., None]).reshape(n, -1)
            new.sort(axis=1)
            fresh = ~seen[rows, new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            seen[rows, new] = True
            cross = np.full(new.shape, np.inf)
            r, c = np.nonzero(fresh)
            cross[r, c] = ((queries[r] - self.centres[new[r, c]]) ** 2).sum(-1)
            ids, gap = np.concatenate([ids, new], axis=1), np.concatenate([gap, cross], axis=1)
            done = np.concatenate([done, ~fresh], axis=1)
            order = np.argsort(gap, axis=1, kind="stable")[:, :width]
            ids, gap, done = ids[rows, order], gap[rows, order], done[rows, order]
        order = np.argsort(gap, axis=1, kind="stable")
        return ids[rows, order], gap[rows, order]


@dataclass(frozen=True)
class Index:
    """``ratio``: lists within so many times the distance of the nearest centre are searched; ``width``: the most of
    them the graph is asked for; ``border``, ``copies``: a vector also stands in lists within so many times the
    distance of its nearest centre, in ``copies`` at most."""

    graph: CentreGraph
    ratio: float
    width: int
    border: float
    copies: int

    def lists_of(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The lists each vector stands in: its nearest, and those whose border it is near."""
        out: list[np.ndarray] = []
        for at in range(0, len(vectors), AT_ONCE):
            ids, gap = self.graph.search(vectors[at : at + AT_ONCE], max(16, self.copies))
            ids, gap = ids[:, : self.copies], gap[:, : self.copies]
            out += [i[: int((g <= self.border**2 * g[0]).sum())] for i, g in zip(ids, gap, strict=True)]
        return out

    def probes_of(self, vectors: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for at in range(0, len(vectors), AT_ONCE):
            ids, gap = self.graph.search(vectors[at : at + AT_ONCE], self.width)
            least = min(4, ids.shape[1])
            out += [i[: max(least, int((g <= self.ratio**2 * g[0]).sum()))] for i, g in zip(ids, gap, strict=True)]
        return out


def fit(x: np.ndarray, n_rows: int, list_size: int = LIST_SIZE, k: int = 10, border: float = 1.05, copies: int = 4, recall: float = 0.95) -> Index:
    """An index for ``n_rows`` rows from a sample of them.

    The ratio is the smallest that would reach ``recall`` for neighbours within the sample; the width is what
    that ratio needs.
    """
    n_lists = int(min(max(1, -(-n_rows // list_size)), MOST_LISTS, max(1, len(x) // 4)))
    graph = CentreGraph(balanced_centres(x, n_lists))
    index = Index(graph, 1.0, 1, border, copies)
    asked, found = x[:512], []
    for s in parts_of(len(asked), len(x)):
        gaps, rows = squares(asked[s], x), np.arange(len(asked))[s]
        gaps[np.arange(len(rows)), rows] = np.inf
        most = min(k, len(x) - 1)
        found.append(np.argpartition(gaps, max(0, most - 1), axis=1)[:, :most])
    near = np.concatenate(found)
    to_lists = squares(asked, graph.centres)
    first = np.maximum(to_lists.min(axis=1), 1e-300)
    wanted = np.unique(near)
    lists = dict(zip(wanted.tolist(), index.lists_of(x[wanted]) if len(wanted) else [], strict=True))
    needed = [np.sqrt(to_lists[q, lists[v]].min() / first[q]) for q in range(len(asked)) for v in near[q].tolist()]
    ratio = float(np.quantile(needed, recall)) + 1e-9 if needed else 1.0
    width = int((to_lists <= ratio**2 * first[:, None]).sum(axis=1).max()) if len(asked) else 1
    return Index(graph, ratio, min(n_lists, max(32, 2 * width)), border, copies)


def search(vectors: DataFrame, queries: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", list_size: int = LIST_SIZE) -> DataFrame:
    """For each row that ``queries`` holds for, the ``k`` nearest other rows found: query_id, rank, vec_id, score.

    The score is the Euclidean distance, in double precision on the vectors as they are; ties go to the smaller id.
    Rows without id, and vectors that are null, empty, zero, of another length than most, or hold null or non-finite
    components, take no part. Each row of a repeated id is a query and a candidate of its own: only the query's own row
    is left out, so rows that share an id may be each other's neighbours. The index is fitted on a sample of bounded size, those of smallest id hash; every row is put in
    its lists. Lists longer than a block are cut in blocks, and so are the queries of a list.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & usable("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dimension, n_rows = lengths[0]["d"], lengths[0]["count"]
    rows = rows.where(F.size("v") == dimension)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, SAMPLE_VALUES // dimension)).select("v").toArrow()
    index = spark.sparkContext.broadcast(fit(matrix(sample.column(0)), n_rows, list_size, k))
    kind = rows.schema["v"].dataType.simpleString()
    rows = rows.withColumn("mark", F.xxhash64("v"))  # tells rows of one id apart

    def place(which: str):
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = getattr(index.value, which)(matrix(batch.column(2)))
            take = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            lists = np.concatenate(found) if found else np.zeros(0, np.int64)
            at = pa.array(take, pa.int64())
            return pa.record_batch([pa.array(lists.astype(np.int32), pa.int32()), *[batch.column(k).take(at) for k in range(3)]], names=["list", "id", "mark", "v"])

        return step

    listed = f"list int, id long, mark long, v {kind}"
    postings = cut(map_arrow(rows.select("id", "mark", "v"), place("lists_of"), listed))
    asked = cut(map_arrow(rows.where("asked").select("id", "mark", "v"), place("probes_of"), listed))
    parts = postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    parts = parts.join(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("q_blocks")), "list")
    parts = F.broadcast(cut(parts))  # a row for each list, MOST_LISTS at most
    spot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = postings.join(parts, "list").select("list", spot("blocks").alias("block"), every("q_blocks").alias("q_block"), "id", "mark", "v")
    right = asked.join(parts, "list").select("list", every("blocks").alias("block"), spot("q_blocks").alias("q_block"), "id", "mark", "v")
    found_schema = "query_id long, q_mark long, q_copy int, vec_id long, mark long, copy int, score double"

    def compare(stored: pa.Table, wanted: pa.Table) -> pa.Table:
        x, q = matrix(stored.column("v")), matrix(wanted.column("v"))
        (ids, marks), (q_ids, q_marks) = ([t.column(c).to_numpy() for c in ("id", "mark")] for t in (stored, wanted))
        # equal rows stand in one block: they are numbered, and a query leaves out the one of its own number
        copies, q_copies = copy_numbers(ids, marks), copy_numbers(q_ids, q_marks)
        out: list[tuple[np.ndarray, ...]] = []
        for s in parts_of(len(q) if len(x) else 0, len(x)):
            part, own = q[s], np.flatnonzero(np.isin(ids, q_ids[s]))
            gap = squares(part, x)
            same = (q_ids[s][:, None] == ids[own][None]) & (q_marks[s][:, None] == marks[own][None]) & (q_copies[s][:, None] == copies[own][None])
            at = np.nonzero(same)
            gap[at[0], own[at[1]]] = np.inf
            last = np.partition(gap, k - 1, axis=1)[:, k - 1] if gap.shape[1] > k else np.full(len(part), np.inf)
            # all that rounding could bring among the first k are measured exactly
            slack = last * (1 + 1e-9) + 1e-9 * ((part * part).sum(1) + (x * x).sum(1).max())
            for i in range(len(part)):
                near = np.flatnonzero((gap[i] <= slack[i]) & np.isfinite(gap[i]))
                score = np.sqrt(((x[near] - part[i]) ** 2).sum(1))
                best = np.lexsort((ids[near], score))[:k]
                row, some = s.start + i, near[best]
                out.append((np.full(len(best), q_ids[row]), np.full(len(best), q_marks[row]), np.full(len(best), q_copies[row]), ids[some], marks[some], copies[some], score[best]))
        columns = [np.concatenate(z) for z in zip(*out, strict=True)] if out else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in found_schema.split(", ")])

    keys = ["list", "block", "q_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, found_schema)
    query = ["query_id", "q_mark", "q_copy"]
    found = found.groupBy(*query, "vec_id", "mark", "copy").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(*query).orderBy("score", "vec_id", "mark", "copy"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def copy_numbers(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The number of each row among the rows that agree with it, from 0."""
    order = np.lexsort((marks, ids))
    new = np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(marks[order]) != 0)][: len(ids)]
    out = np.empty(len(ids), np.int32)
    out[order] = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    return out
