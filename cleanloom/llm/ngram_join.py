"""Documents whose sets of word shingles are near: a Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.llm.common import claim, map_arrow, small_or_shuffled, unused
from cleanloom.llm.components import components
from cleanloom.session import cut, ship_package

WORDS_IN_SHINGLE = 5
#: Two documents link at a similarity of so many hundredths.
PERCENT = 80
#: Shared tokens asked for, as hundredths of a set: of ordinary documents, and of those whose prefix meets many others.
ORDINARY, LENGTHENED = 5, 20
#: A prefix is lengthened if its tokens stand in so many documents, summed.
COSTLY = 2_000
#: Tokens of a block; a task of the last step holds two.
BLOCK_TOKENS = 1_500_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: Words whose hashes a task remembers (about 30 MB); the memory is emptied beyond and goes with the task.
REMEMBERED = 200_000


def shingles(text: str | None, hashes: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles; the whole sequence if it is shorter; empty without words.

    ``hashes`` remembers words between texts.
    """
    hashes = {} if hashes is None else hashes
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and cut at the six blanks
    if not words:
        return np.zeros(0, np.uint64)
    if len(hashes) > REMEMBERED:
        hashes.clear()
    try:
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words):
            if w not in hashes:
                hashes[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS_IN_SHINGLE + 1)
    total = np.full(n, min(len(h), WORDS_IN_SHINGLE), np.uint64)
    for k in range(min(len(h), WORDS_IN_SHINGLE)):
        x = h[k : k + n] * _MIX[k]
        total += (x ^ (x >> np.uint64(32))) * _MIX[(k + 1) % 5]
    total ^= total >> np.uint64(29)
    total *= _MIX[1]
    total ^= total >> np.uint64(32)
    return np.unique(total)


def overlap(n: int | np.ndarray) -> int | np.ndarray:
    """Tokens that a set of ``n`` has in common with any set it links to, at least."""
    return (PERCENT * n + 99) // 100


def matches(n: int, share: int) -> int:
    return max(1, share * n // 100)


def least_matches(n: int, share: int) -> int:
    """Matches that a pair with a set of ``n`` must show: those of the smallest set it can link to."""
    return matches(int(overlap(n)), share)


def prefix(n: int, share: int) -> int:
    """With this prefix of both sets, in any one order of all tokens, sets that link share as many tokens as asked."""
    return n - int(overlap(n)) + matches(n, share)


def node_of(tokens: np.ndarray) -> int:
    """The name of a set: a 64-bit hash of its tokens; equal sets are one node."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def union_links(sets: list[np.ndarray], part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among sets that span their components (indices of sets). With ``part``, only pairs of different parts.

    Sets meet through an inverted index of their prefixes, rarest tokens first. A pair that is connected already is
    not looked at again; the others are counted out exactly.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes = [sets[i] for i in order], sizes[order]
    part = None if part is None else part[order]
    if len(sets) < 2:
        return []
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    local = [token[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    chosen = []
    for tokens, n in zip(local, sizes.tolist(), strict=True):
        head = np.sort(rank[tokens])[: n - int(overlap(n)) + 1]
        chosen.append(head)
    at = np.repeat(np.arange(len(sets)), [len(c) for c in chosen])
    heads = np.concatenate(chosen)
    by = np.argsort(heads, kind="stable")  # for each token, its sets in order of size
    heads, holders = heads[by], at[by]
    first = np.searchsorted(heads, np.arange(len(count)))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    offset = np.cumsum([0, *[len(c) for c in chosen]])
    root, out = np.arange(len(sets)), []
    mark = np.zeros(len(count), bool)
    for i in range(1, len(sets)):
        mine = place[offset[i] : offset[i + 1]]
        begin = first[heads[mine]]
        if not (mine > begin).any():
            continue
        met = np.unique(np.concatenate([holders[a:b] for a, b in zip(begin.tolist(), mine.tolist(), strict=True) if b > a]))
        met = met[(100 * sizes[met] >= PERCENT * sizes[i]) & (root[met] != root[i])]
        if part is not None:
            met = met[part[met] != part[i]]
        if not len(met):
            continue
        mark[local[i]] = True
        for some in np.array_split(met, len(met) // 2000 + 1):
            starts = np.cumsum(sizes[some]) - sizes[some]
            common = np.add.reduceat(mark[np.concatenate([local[j] for j in some])].astype(np.int64), starts)
            near = some[100 * common >= PERCENT * (sizes[some] + sizes[i] - common)]
            for j in near.tolist():
                if root[j] != root[i]:
                    out.append((int(order[i]), int(order[j])))
                    root[root == root[j]] = root[i]
        mark[local[i]] = False
    return out


def sets_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, node, n and the prefix (48 bits of each token, smallest first) of every document with words.

    A task gives the prefix of equal sets once.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("n-gram join", dict)
        seen: set[int] = set()
        hashes: dict[bytes, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                nodes, sizes, heads = [], [], []
                for text in batch.column(1).to_pylist():
                    tokens = shingles(text, hashes)
                    node, n = node_of(tokens), len(tokens)
                    nodes.append(node)
                    sizes.append(n)
                    new = n and node not in seen
                    seen.add(node)
                    heads.append((tokens[: prefix(n, ORDINARY)] >> np.uint64(16)).astype(np.int64) if new else np.zeros(0, np.int64))
                lengths = np.cumsum([0, *[len(h) for h in heads]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64), pa.int64()))
                yield pa.record_batch([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), lists], names=["id", "node", "n", "head"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, node long, n long, head array<long>")


def least_matches_column(n: Column, share: int) -> Column:
    needed = F.floor((PERCENT * n + 99) / 100)
    return F.greatest(F.lit(1), F.floor(share * needed / 100))


def may_link(docs: DataFrame, id_column: str, text_column: str, members: DataFrame) -> DataFrame:
    """Nodes whose prefix shares enough tokens with others to link at all: node, n, id (of one document).

    Any one order of all tokens does for a prefix; here it is their hash, so no counts are needed before. A set that
    links shares ``least_matches`` tokens of its prefix with one other set, so with all others at least as many.
    """
    heads = sets_of(docs, id_column, text_column).select("node", "n", F.explode("head").alias("token"))
    dealt = heads.repartition("token").dropDuplicates(["token", "node"])
    shared = dealt.withColumn("others", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("others > 1")
    enough = shared.groupBy("node", "n").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least_matches_column(F.col("n"), ORDINARY))
    one = members.groupBy("node").agg(F.min("id").alias("id"))
    return cut(enough.select("node", "n").join(one, "node"))


def prefixes(sets: DataFrame) -> DataFrame:
    """Postings of the prefixes in order of rising counts: token, node, n, costly, base (within the ordinary prefix).

    Tokens of one set alone come first in that order and match nothing, so only their number counts; a set with too
    few other tokens links with nothing. A prefix whose tokens stand in many sets is lengthened, and its node then needs
    more matches.
    """
    rows = sets.select("node", "n", F.explode("tokens").alias("token")).repartition("token").dropDuplicates(["token", "node"])
    rows = rows.withColumn("count", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("count > 1")
    rows = rows.groupBy("node", "n").agg(F.collect_list(F.struct("count", "token")).alias("tokens"))
    rows = rows.where(F.size("tokens") >= F.floor((PERCENT * F.col("n") + 99) / 100))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for node, n, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            pairs = tokens.values.flatten()
            count, token = pairs[0].to_numpy(zero_copy_only=False), pairs[1].to_numpy(zero_copy_only=False)
            order = np.lexsort((token, count))
            alone = n - len(token)
            base = max(0, prefix(n, ORDINARY) - alone)
            costly = int(count[order[:base]].sum()) > COSTLY
            length = max(0, prefix(n, LENGTHENED) - alone) if costly else base
            out.extend((t, node, n, costly, i < base) for i, t in enumerate(token[order[:length]].tolist()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["token", "node", "n", "costly", "base"])

    return map_arrow(rows, step, "token long, node long, n long, costly boolean, base boolean")


def candidate_groups(postings: DataFrame) -> DataFrame:
    """Groups of nodes that share prefix tokens, after those with too few matches are gone: node, label.

    Two ordinary nodes, or an ordinary and a lengthened one, must share enough tokens of their ordinary prefixes; two
    lengthened ones more, of their lengthened prefixes.
    """
    by = Window.partitionBy("token")
    ordinary = F.sum((~F.col("costly")).cast("int")).over(by)
    costly = F.sum(F.col("costly").cast("int")).over(by)
    costly_base = F.sum((F.col("costly") & F.col("base")).cast("int")).over(by)
    rows = cut(postings.repartition("token").select("*", ordinary.alias("ordinary"), costly.alias("lengthened"), costly_base.alias("in_base")).where("ordinary + lengthened > 1"))
    plain = F.when(F.col("costly"), F.col("base") & (F.col("ordinary") > 0)).otherwise((F.col("ordinary") > 1) | (F.col("in_base") > 0))
    long = F.col("costly") & (F.col("lengthened") > 1)
    kept = rows.groupBy("node", "n").agg(F.sum(plain.cast("int")).alias("plain"), F.sum(long.cast("int")).alias("long"))
    kept = kept.where(
        (F.col("plain") >= least_matches_column(F.col("n"), ORDINARY)) | (F.col("long") >= least_matches_column(F.col("n"), LENGTHENED))
    ).select("node")
    rows = rows.join(small_or_shuffled(cut(kept)), "node").select("token", "node")
    hub = rows.groupBy("token").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    edges = rows.join(hub, "token").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    return components(edges)


def links(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Links that span the components of every group: a, b (nodes).

    Small groups share a block; a group beyond a block is cut in parts by node, and each two parts meet in a task.
    """
    members = sets.join(small_or_shuffled(groups), "node").select("node", "label", "tokens")
    sizes = cut(sets.select("node", F.size("tokens").alias("size")).join(small_or_shuffled(groups), "node").groupBy("label").agg(F.sum("size").alias("size")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    bins = max(1, -(-total * 4 // BLOCK_TOKENS))
    parts = sizes.select("label", F.ceil(F.col("size") / BLOCK_TOKENS).cast("int").alias("parts"))
    placed = members.join(small_or_shuffled(parts), "label")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = F.when(F.col("parts") > 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(bins)))
    placed = placed.select(
        group.alias("group"), (F.col("parts") > 1).alias("cut"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "label", "part", "tokens"
    )

    def meet(table: pa.Table) -> pa.Table:
        nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
        tokens = table.column("tokens").combine_chunks()
        ends, values = tokens.offsets.to_numpy(), tokens.values.to_numpy(zero_copy_only=False)
        sets_here = [values[ends[k] : ends[k + 1]] for k in first]
        label, part = table.column("label").to_numpy()[first], table.column("part").to_numpy()[first]
        apart = table.column("cut")[0].as_py() and table.column("i")[0].as_py() != table.column("j")[0].as_py()
        found = []
        for one in np.unique(label):
            here = np.flatnonzero(label == one)
            found += [(nodes[here[a]], nodes[here[b]]) for a, b in union_links([sets_here[k] for k in here], part[here] if apart else None)]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return placed.groupBy("group", "cut", "i", "j").applyInArrow(meet, "a long, b long")


def near_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Components of documents linked by near sets of shingles: ``id_column``, n_shingles, component_id.

    Two documents link if their sets have a Jaccard similarity of 0.8 or more; equal sets are one node throughout, so
    copies are never paired. ``component_id`` is the smallest id that links reach. A text that is null, empty or
    without words has no set and stands alone. Null ids count as largest; rows that share an id are documents of their
    own. Sets and tokens are told apart by 64-bit hashes.
    """
    members = cut(sets_of(docs, id_column, text_column).select("id", "node", "n"))
    nodes = may_link(docs, id_column, text_column, members.where("n > 0"))
    wanted = small_or_shuffled(nodes.select(F.col("id").alias("_id"), F.col("node").alias("_node")))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).join(wanted, F.col("id").eqNullSafe(F.col("_id")))

    hashes: dict[bytes, int] = {}  # each task gets this empty

    def full(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        found = [(node, s) for node, text in pairs if node_of(s := shingles(text, hashes)) == node]
        ends = np.cumsum([0, *[len(s) for _, s in found]]).astype(np.int32)
        values = np.concatenate([np.zeros(0, np.uint64), *[s for _, s in found]]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
        return pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), lists], names=["node", "n", "tokens"])

    sets = cut(map_arrow(texts.select("_node", "text"), full, "node long, n long, tokens array<long>"))
    labels = components(links(sets, candidate_groups(prefixes(sets))))
    placed = members.join(small_or_shuffled(labels), "node", "left").withColumn("group", F.coalesce("label", "node"))
    placed = cut(placed.select("id", "n", "group"))
    first = placed.where("n > 0").groupBy("group").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("m")).where("m > 1").select("group", "component_id")
    out = placed.join(first, "group", "left")
    component = F.when((F.col("n") > 0) & F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component: those with its smallest id.

    Texts that are null or without words stay, and so do all rows that share the smallest id. Null ids count as
    largest; an empty table stays empty; columns of any name pass through.
    """
    found = near_documents(docs.select(id_column, text_column), id_column, text_column)
    name = unused("gone", docs.columns)
    gone = found.where(~F.col("component_id").eqNullSafe(F.col(id_column))).select(F.col(id_column).alias(name)).distinct()
    gone = small_or_shuffled(cut(gone))
    return docs.join(gone, docs[id_column].eqNullSafe(gone[name]), "left_anti")
