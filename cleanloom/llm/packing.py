"""Best-fit packing of documents into sequences by a grouping genetic algorithm over islands."""

from __future__ import annotations

import json
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cleanloom.llm.common import map_arrow, small_or_shuffled
from cleanloom.session import cut, ship_package

CAPACITY = 1024
#: Islands, packings of an island, children of an island in an epoch, epochs, and packings that move on between epochs.
ISLANDS, POPULATION, CHILDREN, EPOCHS, ELITE = 6, 8, 250, 4, 2
#: Documents of a block, in which they are numbered apart.
BLOCK_DOCUMENTS = 20_000
#: Fixed value: how byte-level vocabularies cut a text into words.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}++$|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}"

#: Groups (lengths in falling order) and how many sequences hold such a group. Documents of one length stand for each
#: other, so a packing of any number of documents is a table of groups.
Packing = dict[tuple[int, ...], int]


class Ids:
    """Token ids of texts as the tokenizers library gives them, packed as 32-bit numbers.

    A byte-level vocabulary without normaliser whose merges stand in the order of their ids is run by tiktoken, which
    gives the same ids in a quarter of the time; any other file by the library itself.
    """

    def __init__(self, vocabulary: str):
        from cleanloom.llm.bpe import printable_bytes

        model = json.loads(vocabulary)
        before, kind = model.get("pre_tokenizer") or {}, model["model"]
        ranks = {}
        plain = kind.get("type") == "BPE" and not model.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        plain = plain and not before.get("add_prefix_space") and not any(kind.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        plain = plain and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in model["added_tokens"])
        if plain:
            as_byte = printable_bytes()
            ranks = {bytes(as_byte[c] for c in s): i for s, i in kind["vocab"].items() if s not in special}
            pairs = [p.split(" ") if isinstance(p, str) else p for p in kind["merges"]]
            made = [ranks.get(bytes(as_byte[c] for c in a + b), -1) for a, b in pairs]
            plain = len(ranks) == 256 + len(pairs) and all(x < y for x, y in zip([255, *made], made, strict=False))
        if plain:
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
            self.slow = None
        else:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(vocabulary)
            self.slow.no_truncation()
            self.slow.no_padding()

    def of(self, text: str) -> np.ndarray:
        if self.slow is not None:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def pieces(docs: DataFrame, vocabulary_path: str, end_id: int = 2, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, crcs: every document's ids with the end id, and the crc32 of each of its pieces.

    A document of more than ``capacity`` ids is cut into pieces of that length; the first may be shorter. A null text is
    an empty one: one piece with the end id alone. No text is shuffled.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    held: dict[str, Ids] = {}

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:  # one encoder for each task, gone with it
            held["ids"] = Ids(vocabulary.value)
        encode, end = held["ids"].of, np.array([end_id], "<u4")
        counts, crcs = [], []
        for text in batch.column(1).to_pylist():
            data = memoryview(np.concatenate([encode(text or ""), end]).tobytes())
            n = len(data) // 4
            first = (n - 1) % capacity + 1
            counts.append(n)
            crcs.append([zlib.crc32(data[:4 * first]), *[zlib.crc32(data[4 * i : 4 * (i + capacity)]) for i in range(first, n, capacity)]])
        return pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "n_tokens", "crcs"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_arrow(rows, step, f"doc_id {kind}, n_tokens long, crcs array<long>")


def best_fit(packing: Packing, lengths: Counter, capacity: int, order: list[int] | None = None) -> None:
    """Put documents of ``lengths`` where the least room is left that takes them, else in new sequences; longest first."""
    room: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    open_ = 0  # bit f: there are groups with f left
    for group, m in packing.items():
        free = capacity - sum(group)
        if free:
            room[free][group] = m
            open_ |= 1 << free
    for s in order or sorted(lengths, reverse=True):
        count = lengths[s]
        while count:
            fitting = open_ >> s
            if not fitting:
                k = min(count, capacity // s)
                group, m = (s,) * k, count // k
                free, count = capacity - s * k, count - m * k
            else:
                f = s + (fitting & -fitting).bit_length() - 1
                old, there = room[f].popitem()
                m = min(there, count)
                if there > m:
                    room[f][old] = there - m
                elif not room[f]:
                    open_ &= ~(1 << f)
                packing[old] -= m
                if not packing[old]:
                    del packing[old]
                group, free, count = tuple(sorted((*old, s), reverse=True)), f - s, count - m
            packing[group] = packing.get(group, 0) + m
            if free:
                room[free][group] = room[free].get(group, 0) + m
                open_ |= 1 << free


def worth(packing: Packing) -> tuple[int, int]:
    """Less is better: sequences, then the squares of what they hold, which prefers full ones beside empty ones."""
    return sum(packing.values()), -sum(m * sum(g) ** 2 for g, m in packing.items())


def crossover(a: Packing, b: Packing, capacity: int, rng: random.Random) -> Packing:
    """``a`` with whole well-filled sequences of ``b``.

    What they hold stands twice then: sequences of ``a`` with such documents go, the emptiest first, and their other
    documents are displaced and best-fitted.
    """
    least = rng.choice((capacity, capacity - 1, int(0.99 * capacity), int(0.95 * capacity)))
    brought = {g: m if rng.random() < 0.5 else rng.randint(1, m) for g, m in b.items() if sum(g) >= least and rng.random() < 0.5}
    child, twice = dict(a), Counter()
    for g, m in brought.items():
        same = min(m, child.get(g, 0))  # the same group in both: nothing stands twice
        if m > same:
            for s in g:
                twice[s] += m - same
    kept = {g: min(m, brought.get(g, 0)) for g, m in child.items()}
    displaced: Counter[int] = Counter()
    for g in sorted(child, key=sum):
        spare = child[g] - kept[g]
        mine = Counter(g)
        while spare and (wanted := max(-(-twice[s] // c) if twice[s] > 0 else 0 for s, c in mine.items())):
            k = min(spare, wanted)
            spare -= k
            child[g] -= k
            for s, c in mine.items():
                taken = min(twice[s], c * k)
                twice[s] -= taken
                displaced[s] += c * k - taken
    for g, m in brought.items():
        child[g] = max(child.get(g, 0), m) if g in a else m
    child = {g: m for g, m in child.items() if m}
    best_fit(child, +displaced, capacity)
    return child


def swap(packing: Packing, loose: Counter, capacity: int, rng: random.Random) -> None:
    """Loose documents take the place of slightly shorter ones in sequences with room, so that shorter ones are left over."""
    groups = [g for g in packing if sum(g) < capacity]
    rng.shuffle(groups)
    for g in groups:
        free = capacity - sum(g)
        for s in dict.fromkeys(g):
            t = next((t for t in range(s + free, s, -1) if loose[t]), 0)
            if t:
                m = min(packing[g], loose[t])
                packing[g] -= m
                if not packing[g]:
                    del packing[g]
                at = g.index(s)
                new = tuple(sorted((*g[:at], t, *g[at + 1 :]), reverse=True))
                packing[new] = packing.get(new, 0) + m
                loose[t] -= m
                loose[s] += m
                break


def mutation(packing: Packing, capacity: int, rng: random.Random) -> Packing:
    """A few of the emptiest sequences and a few others are dissolved; their documents are swapped for shorter ones and best-fitted."""
    child, loose = dict(packing), Counter()
    groups = list(child)
    weak = sorted(groups, key=sum)[: rng.randint(1, 12)]
    for g in {*rng.sample(weak, rng.randint(1, len(weak))), *rng.sample(groups, min(len(groups), rng.randint(0, 24)))}:
        m = child.pop(g)
        gone = rng.randint(1, m)
        if m > gone:
            child[g] = m - gone
        for s in g:
            loose[s] += gone
    for _ in range(rng.randint(0, 3)):
        swap(child, loose, capacity, rng)
    best_fit(child, +loose, capacity, sorted(+loose, key=lambda s: -s * (1 + 0.2 * rng.random())) if rng.random() < 0.3 else None)
    return child


def evolve(population: list[Packing], least: int, children: int, capacity: int, rng: random.Random) -> list[Packing]:
    """The population after ``children`` children, each in the place of the worst; it ends where ``least`` sequences are met."""
    ranked = sorted([(worth(p), i, p) for i, p in enumerate(population)], key=lambda x: x[:2])
    for number in range(children):
        if ranked[0][0][0] <= least:
            break
        one, other = sorted(rng.sample(range(len(ranked)), 2)) if len(ranked) > 1 else (0, 0)
        child = crossover(ranked[one][2], ranked[other][2], capacity, rng)
        if rng.random() < 0.5:
            child = mutation(child, capacity, rng)
        value = worth(child)
        if value < ranked[-1][0] and all(value != r[0] for r in ranked):
            ranked[-1] = (value, len(population) + number, child)
            ranked.sort(key=lambda x: x[:2])
    return [p for _, _, p in ranked]


def first_population(lengths: Counter, size: int, capacity: int, rng: random.Random, plain: bool) -> list[Packing]:
    """Best-fit packings in falling order of length, all but the first in an order changed by chance."""
    out = []
    for i in range(size):
        packing: Packing = {}
        noise = 0.0 if plain and not i else 0.3 * rng.random()
        best_fit(packing, lengths, capacity, sorted(lengths, key=lambda s: -s * (1 + noise * rng.random())))
        out.append(packing)
    return out


def pack_lengths(
    spark: SparkSession, lengths: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, population: int = POPULATION, children: int = CHILDREN, epochs: int = EPOCHS, elite: int = ELITE
) -> Packing:
    """A packing of so many documents of each length into few sequences.

    Each island is a row and evolves in a task of its own; after an epoch its best packings move to the next island of
    the ring and replace the worst there. ``lengths`` has ``capacity`` entries at most, and packings are tables of groups, so
    neither grows with the number of documents. The islands' random numbers depend on the island and epoch alone.
    """
    if not lengths:
        return {}
    ship_package(spark)
    counts, total = Counter(lengths), sum(s * n for s, n in lengths.items())
    big = sum(n for s, n in lengths.items() if 2 * s > capacity)
    least = max(-(-total // capacity), big)
    shared = spark.sparkContext.broadcast(counts)
    state = spark.range(0, islands, 1, islands).select(F.col("id").alias("island"), F.lit(None).cast("binary").alias("own"), F.lit(None).cast("binary").alias("guests"))
    for epoch in range(epochs):

        def step(batch: pa.RecordBatch, epoch: int = epoch) -> pa.RecordBatch:
            own, best, sequences = [], [], []
            for island, packed, guests in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                rng = random.Random(1000 * epoch + island)
                here = pickle.loads(packed) if packed else first_population(shared.value, population, capacity, rng, island == 0)
                if guests:
                    here = sorted(here, key=worth)[: max(1, population - elite)] + pickle.loads(guests)
                here = evolve(here, least, children, capacity, rng)
                own.append(pickle.dumps(here))
                best.append(pickle.dumps(here[:elite]))
                sequences.append(sum(here[0].values()))
            return pa.record_batch([batch.column(0), pa.array(own, pa.binary()), pa.array(best, pa.binary()), pa.array(sequences, pa.int64())], names=["island", "own", "best", "sequences"])

        evolved = cut(map_arrow(state, step, "island long, own binary, best binary, sequences long"))
        top = evolved.orderBy("sequences", "island").select("sequences", "best").first()
        if top["sequences"] <= least:
            break
        guests = evolved.select(F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("best").alias("guests"))
        state = evolved.select("island", "own").repartition(islands, "island").join(guests, "island")
    return pickle.loads(bytes(top["best"]))[0]


def slots(packing: Packing, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each run of documents of one length (numbered within it from 0): key (length and first number), first sequence,
    place in the sequence; and the number of sequences."""
    keys, firsts, places, base = [], [], [], 0
    used: Counter[int] = Counter()
    for group in sorted(packing, reverse=True):
        at, m = 0, packing[group]
        for s in group:
            keys.append(s << 44 | used[s])
            firsts.append(base)
            places.append(at)
            used[s] += m
            at += s
        base += m
    order = np.argsort(np.array(keys, np.int64))
    return np.array(keys, np.int64)[order], np.array(firsts, np.int64)[order], np.array(places, np.int64)[order], base


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, n_tokens, crcs, first) with number (among the rows of equal ``first``) and ahead (whole pieces of rows before).

    The rows are dealt out by a hash and numbered in blocks; the blocks' counts by length are summed up apart.
    """
    total = rows.count()
    blocks = max(1, -(-total // BLOCK_DOCUMENTS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "n_tokens", "crcs"), F.lit(blocks)))
    more = F.size("crcs") - 1
    counts = cut(rows.groupBy("block", "first").agg(F.count(F.lit(1)).alias("n"), F.sum(more).alias("more")))
    earlier = Window.partitionBy("first").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = counts.groupBy("block").agg(F.sum("more").alias("more"))
    until = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    whole = whole.select(F.col("block").alias("b"), F.coalesce(F.sum("more").over(until), F.lit(0)).alias("whole_before"))
    starts = counts.select(F.col("block").alias("b"), F.col("first").alias("f"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).join(whole, "b")
    order = ["doc_id", "n_tokens", "crcs"]
    inside = F.row_number().over(Window.partitionBy("block", "first").orderBy(*order)) - 1
    running = F.coalesce(F.sum(more).over(Window.partitionBy("block").orderBy("first", *order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.repartition("block").withColumn("inside", inside).withColumn("running", running)
    rows = rows.join(small_or_shuffled(starts), (F.col("block") == F.col("b")) & (F.col("first") == F.col("f")))
    return rows.select(*order, "first", (F.col("before") + F.col("inside")).alias("number"), (F.col("whole_before") + F.col("running")).alias("ahead"))


def pack(
    docs: DataFrame, vocabulary_path: str, end_id: int = 2, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """All documents in sequences of ``capacity`` ids at most: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Whole pieces are sequences of their own; the others are packed by :func:`pack_lengths` from the counts of their
    lengths, and each document takes the slot of its number among those of its length. Ids may be null or repeat;
    equal rows are documents of their own. An empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    cut_up = cut(pieces(docs, vocabulary_path, end_id, capacity, id_column, text_column))
    rows = cut_up.withColumn("first", (F.pmod(F.col("n_tokens") - 1, F.lit(capacity)) + 1))
    lengths = {r["first"]: r["n"] for r in rows.groupBy("first").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    whole = lengths.pop(capacity, 0)
    packing = pack_lengths(spark, lengths, capacity, **options)
    if whole:
        packing[(capacity,)] = whole
    placed = spark.sparkContext.broadcast(slots(packing, capacity))
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, firsts, places, sequences = placed.value
        n_tokens, first, number, ahead = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 3, 4, 5))
        run = np.searchsorted(keys, first << 44 | number, "right") - 1
        sequence, place = firsts[run] + number - (keys[run] & ((1 << 44) - 1)), places[run]
        crcs = batch.column(2)
        ends = crcs.offsets.to_numpy().astype(np.int64)
        count = np.diff(ends)
        row = np.repeat(np.arange(batch.num_rows), count)
        piece = np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], count)
        head = piece == 0
        columns = [
            batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(np.where(head, 0, first[row] + (piece - 1) * capacity)),
            pa.array(np.where(head, first[row], capacity)), crcs.flatten(),
            pa.array(np.where(head, sequence[row], sequences + ahead[row] + piece - 1)), pa.array(np.where(head, place[row], 0)),
        ]
        return pa.record_batch(columns, names=[c.split()[0] for c in schema.split(", ")])

    return map_arrow(numbered(rows), step, schema)
