"""Conversation repair: the cheapest edits to a legal order of roles, by lookups in tables of symbol blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.common import BLANKS, small_or_shuffled
from cleanloom.session import cut, ship_package

#: Fixed by the contract: costs of the edits, and the roles that Rerole and Insert may give.
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 1, 2, 5, 5
ROLES = ("user", "assistant")
#: A row is a symbol: its fault (none, truncated, must go) times 4 plus its initial (s, u, a, other).
INITIALS = "sua"
FINE, TRUNCATED, GONE = range(3)
#: States of ``(s?(ua)+)?``: nothing yet, behind s, behind u, behind a; what a user or assistant row leads to.
NEXT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3})
ANY = {0: 2, 1: 2, 2: 3, 3: 2}
#: Rows of a block of the tables; symbols of a piece of a conversation that are handed on together.
BLOCK = 4
PIECE = 65_536


def filled(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(" "))


def damage(rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """conv_id, turn, role, text: the rows after a damage that their id and turn decide (crc32 of ``id:turn``, modulo 20).

    0 drops the row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it a user's. A null role, text,
    id or turn counts as one space in this; null ids and turns stay null in the result.
    """
    h = F.crc32(F.concat(filled(id_column), F.lit(":"), filled(F.col(turn_column).cast("long"))).cast("binary")) % 20
    rows = rows.select(
        F.col(id_column).alias("conv_id"), F.col(turn_column).cast("long").alias("turn"), filled(role_column).alias("role"), filled(text_column).alias("text"), h.alias("h")
    ).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, ROLES[0]).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1))).alias("_")).drop("_")


def closed(base: list[int]) -> tuple[int, ...]:
    """Costs to the end from each state, with rows that are inserted before the next row."""
    b0, b1, b2, b3 = base
    v2, v3 = min(b2, INSERT + b3), min(b3, INSERT + b2)
    return min(b0, INSERT + v2), min(b1, INSERT + v2), v2, v3


class BlockTables:
    """Cost vectors (from each state to the end, less their least value) and what rows before them make of them.

    ``step``, ``gain``: for a vector and a symbol the vector in front of that row, and what its least value gained;
    ``block_step``, ``block_gain``: the same for every block of ``BLOCK`` symbols; ``trace``: for the vector behind a row,
    its symbol and the state before it, the least letters of the cheapest edits up to that row, and the state after.
    Vectors are numbered as they are met from the end; there are few, as edits bound the differences.
    """

    SYMBOLS = 9  # rows that must go are one symbol whatever their initial

    def __init__(self):
        end = closed([0, 99, 99, 0])
        self.vectors, number = [end], {end: 0}
        step, gain, self.trace = [], [], []
        for behind in self.vectors:  # grows while vectors are met
            step.append([])
            gain.append([])
            self.trace.append([])
            for symbol in range(self.SYMBOLS):
                base = [min(c + behind[q] for _, c, q in self.edits(symbol, p)) for p in range(4)]
                here = closed(base)
                least = min(here)
                plain = tuple(x - least for x in here)
                if plain not in number:
                    number[plain] = len(self.vectors)
                    self.vectors.append(plain)
                step[-1].append(number[plain])
                gain[-1].append(least)
                self.trace[-1].append([self.letters(symbol, p, here, behind) for p in range(4)])
        self.step, self.gain = np.array(step, np.int32), np.array(gain, np.int64)
        size = self.SYMBOLS**BLOCK
        at, total = np.repeat(np.arange(len(step))[:, None], size, axis=1), np.zeros((len(step), size), np.int64)
        for symbols in np.array(list(product(range(self.SYMBOLS), repeat=BLOCK)), np.int64).T[::-1]:  # last row first
            total += self.gain[at, symbols]
            at = self.step[at, symbols]
        self.block_step, self.block_gain = at, total
        self.end_letters = ("", "II", "I", "")

    @staticmethod
    def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
        """Letter, cost and next state of what may be done with a row, letters ascending."""
        fault, initial = divmod(symbol, 4)
        out = [("D", DELETE, state)]
        if fault != GONE:
            more = LEFT_TRUNCATED if fault == TRUNCATED else 0
            if initial < 3 and state in NEXT[initial]:
                out.append(("K", KEEP + more, NEXT[initial][state]))
            out.append(("R", REROLE + more, ANY[state]))
        return out

    def letters(self, symbol: int, state: int, here: tuple[int, ...], behind: tuple[int, ...]) -> tuple[str, int]:
        out = ""
        while True:
            cheapest = [(letter, q) for letter, c, q in self.edits(symbol, state) if c + behind[q] == here[state]]
            if INSERT + here[ANY[state]] == here[state]:
                cheapest.append(("I", -1))
            letter, q = min(cheapest)
            out += letter
            if letter != "I":
                return out, q
            state = ANY[state]

    def solve(self, symbols: bytes) -> tuple[int, str]:
        """The least cost, and of the cheapest edits the ASCII-least letters."""
        codes = np.minimum(np.frombuffer(symbols, np.uint8), self.SYMBOLS - 1).astype(np.int64)
        n, cost, vector = len(codes), 0, 0
        whole = n - n % BLOCK
        for s in codes[whole:][::-1].tolist():
            cost += int(self.gain[vector, s])
            vector = int(self.step[vector, s])
        weights = self.SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
        blocks = (codes[:whole].reshape(-1, BLOCK) @ weights).tolist()
        behind = np.zeros(len(blocks) + 1, np.int32)  # the vector behind each block
        behind[len(blocks)] = vector
        for k in range(len(blocks) - 1, -1, -1):
            cost += int(self.block_gain[vector, blocks[k]])
            vector = int(self.block_step[vector, blocks[k]])
            behind[k] = vector
        cost += self.vectors[vector][0]
        state, out = 0, []
        for k in range(len(blocks) + 1):
            part = codes[k * BLOCK : min(n, (k + 1) * BLOCK)].tolist()
            inner = [int(behind[k + 1])] if k < len(blocks) else [0]
            for s in part[:0:-1]:  # the block is opened from its end: the vector behind each of its rows
                inner.append(int(self.step[inner[-1], s]))
            for s, v in zip(part, reversed(inner), strict=False):
                letters, state = self.trace[v][s][state]
                out.append(letters)
        return cost, "".join(out) + self.end_letters[state]


@lru_cache(1)
def tables() -> BlockTables:
    return BlockTables()


def illegal_pairs(symbols: bytes) -> int:
    initial = np.frombuffer(symbols, np.uint8) % 4
    a, b = initial[:-1], initial[1:]
    legal = (a == 0) & (b == 1) | (a == 1) & (b == 2) | (a == 2) & (b == 1)
    return int(len(a) - legal.sum())


def units(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, h (md5 of the text), n (equal rows), blank, cut_off, again (an equal role and text came at an earlier turn).

    Equal rows are counted before the shuffle, and the first turns are joined back, so a conversation or a text that
    repeats without end is in no single task.
    """
    bare = F.rtrim("text", F.lit(BLANKS))
    found = rows.select(
        "conv_id", "turn", "role", F.md5("text").alias("h"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut_off")
    ).groupBy("conv_id", "turn", "role", "h", "blank", "cut_off").agg(F.count(F.lit(1)).alias("n"))
    found = cut(found)
    turn = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))
    first = found.where("NOT blank").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("k")).agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("turns"))
    first = small_or_shuffled(cut(first.where("turns > 1").drop("turns")))
    joined = found.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("k")), "left")
    return joined.select("conv_id", "turn", "role", "h", "n", "blank", "cut_off", F.coalesce(F.col("first") < turn, F.lit(False)).alias("again"))


def symbol_pieces(found: DataFrame) -> DataFrame:
    """conv_id, seq, symbols: the rows of every conversation in order, a byte for each, in pieces.

    The rows are dealt out by ranges of their order, so a long conversation is cut over many tasks.
    """
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == x, F.lit(i)) for i, x in enumerate(INITIALS)], F.lit(3))
    gone = F.col("blank") | F.col("again")
    first = F.when(gone, GONE).when(F.col("cut_off"), TRUNCATED).otherwise(FINE) * 4 + initial
    order = ["conv_id", "turn", "role", "h"]
    rows = found.select(*order, first.cast("int").alias("first"), (initial + 4 * GONE).cast("int").alias("rest"), "n")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "first", "rest", "n")
    kind = found.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, whose, held = TaskContext.get().partitionId() << 40, None, bytearray()
        for batch in batches:
            at, ids, seqs, pieces = batch.column(0), [], [], []
            for i, (conv, first, rest, n) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True)):
                if held and (conv != whose or len(held) >= PIECE):
                    ids.append(whose)
                    seqs.append(seq)
                    pieces.append(bytes(held))
                    seq, held = seq + 1, bytearray()
                whose = conv
                held.append(first)
                held.extend(bytes([rest]) * (n - 1))
            yield pa.record_batch([pa.array(ids, at.type), pa.array(seqs, pa.int64()), pa.array(pieces, pa.binary())], names=["conv_id", "seq", "symbols"])
            kept = at.type
        if held:
            yield pa.record_batch([pa.array([whose], kept), pa.array([seq], pa.int64()), pa.array([bytes(held)], pa.binary())], names=["conv_id", "seq", "symbols"])

    return rows.mapInArrow(run, f"conv_id {kind}, seq long, symbols binary")


def repair(rows: DataFrame, with_rows: bool = False, found: DataFrame | None = None) -> DataFrame:
    """The cheapest repair of every conversation of ``rows`` (conv_id, turn, role, text, none of the last two null).

    conv_id, cost, illegal, audit, repaired_sha256; with ``with_rows`` the repaired rows: conv_id, place (from 0), edit, role,
    text. The order of a conversation is that of its turns, nulls first; rows of one turn stand in order of role and of
    the md5 of their text, so equal rows are neighbours. The edits are the cheapest, of equals the ASCII-least letters.
    A null conv_id is a conversation too. Empty tables give empty ones.

    A task gets the symbols of a conversation, a byte a row, then its texts in order as a stream, of which it keeps a
    digest: the audit and the digest are one value of one row, so one task writes them, in memory of a byte a row.
    """
    ship_package(rows.sparkSession)
    found = cut(units(rows)) if found is None else found
    kind = rows.schema["conv_id"].dataType.simpleString()
    pieces = symbol_pieces(found).selectExpr("conv_id", "seq", "CAST(NULL AS long) AS turn", "CAST(NULL AS string) AS role", "CAST(NULL AS string) AS h", "symbols AS data")
    texts = rows.select("conv_id", F.lit(1 << 62).alias("seq"), "turn", "role", F.md5("text").alias("h"), F.encode("text", "UTF-8").alias("data"))
    order = ["conv_id", "seq", "turn", "role", "h"]
    stream = pieces.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "seq", "role", "data")
    out_schema = f"conv_id {kind}, " + ("place long, edit string, role string, text string" if with_rows else "cost long, illegal long, audit string, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, state, place, audit, symbols, whose, digest, cost = 0, 0, 0, "", bytearray(), None, hashlib.sha256(), 0
        began = False

        def put(letter: str, role: str, data: bytes) -> None:
            nonlocal place
            if with_rows:
                out.append((whose, place, letter, role, data.decode()))
            else:
                digest.update(b"\n" * (place > 0) + role.encode() + b":" + data)
            place += 1

        def inserted() -> None:
            nonlocal at, state
            while audit[at : at + 1] == "I":
                state = ANY[state]
                put("I", ROLES[state - 2], b"")
                at += 1

        def end() -> None:
            inserted()
            if not with_rows:
                out.append((whose, cost, illegal_pairs(bytes(symbols)), audit, digest.hexdigest()))

        def made(kind_of: pa.DataType) -> pa.RecordBatch:
            names = [c.split()[0] for c in out_schema.split(", ")]
            types = [kind_of, *([pa.int64(), pa.string(), pa.string(), pa.string()] if with_rows else [pa.int64(), pa.int64(), pa.string(), pa.string()])]
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)], names=names)
            out.clear()
            return batch

        kept = None
        for whole in batches:
            kept = whole.column(0).type
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                for conv, seq, role, data in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                    if not began or conv != whose:
                        if began:
                            end()
                        began, whose, symbols, audit, at, state, place, digest = True, conv, bytearray(), "", 0, 0, 0, hashlib.sha256()
                    if seq < 1 << 62:
                        symbols += data
                        continue
                    if not audit:
                        cost, audit = tables().solve(bytes(symbols))
                    inserted()
                    letter = audit[at]
                    at += 1
                    if letter == "K":
                        state = NEXT[INITIALS.index(role[0])][state]
                        put("K", role, data)
                    elif letter == "R":
                        state = ANY[state]
                        put("R", ROLES[state - 2], data)
                yield made(kept)
        if began:
            end()
            yield made(kept)

    return stream.mapInArrow(run, out_schema)


def report(conversations: DataFrame, damaged: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """A row for each id of ``conversations``: what is wrong in ``damaged`` (rows of :func:`damage`), and its cheapest repair.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A row's first fault counts:
    blank, an equal role and text before, a last mark that ends no sentence. ``gaps``: turns that lack between the least
    and the largest, 0 where all are null. Ids without rows in ``damaged`` have zeros, no audit and the digest of nothing.
    """
    found = cut(units(damaged))
    fault = lambda c: F.sum(c).cast("long")
    fine = ~F.col("blank")
    facts = found.groupBy(F.col("conv_id").alias("c")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        fault(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        fault(F.when(fine, F.col("n") - (~F.col("again")).cast("int")).otherwise(0)).alias("duplicate"),
        fault((fine & ~F.col("again") & F.col("cut_off")).cast("int")).alias("truncated"),
    )
    ids = conversations.select(F.col(id_column).alias("conv_id")).distinct()
    mended = repair(damaged, found=found).withColumnRenamed("conv_id", "d")
    rows = ids.join(facts, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(mended, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    zero = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
