"""Token ids in binary files: Simple-8b words, blocks with offsets, documents in order."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.llm.bpe import printable_bytes
from cleanloom.llm.common import claim, shared_folder
from cleanloom.session import ship_package

#: Fixed values of the coding: how many numbers a 64-bit word holds and their bits, by selector. Selector 0 is the
#: escape: the next word is one number as it is.
COUNTS = np.array([1, 240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2], np.int64)
BITS = np.array([64, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30], np.int64)
MAGIC = b"S8BT0001"
#: Ids in a block; a block starts with a new word, so blocks are read apart.
BLOCK = 65_536
#: Bytes of text whose distinct runs are encoded together.
PORTION = 2_000_000


def pack_block(ids: np.ndarray) -> np.ndarray:
    """The ids as 64-bit words, each with as many of the next ids as fit."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    # selector[i]: of the word that starts at i; later selectors hold fewer numbers, so the first that fits wins
    width = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)  # bits of each number
    selector = np.zeros(n, np.uint8)
    for s in range(15, 0, -1):
        c = int(COUNTS[s])
        narrow = width <= BITS[s]
        if c > n:
            continue
        if c <= 8:
            fit = narrow[: n - c + 1].copy()
            for k in range(1, c):
                fit &= narrow[k : n - c + 1 + k]
        else:
            wide = np.flatnonzero(~narrow)
            if np.diff(wide, prepend=-1, append=n).max() <= c:
                continue  # no run is long enough
            ahead = np.concatenate([[0], np.cumsum(~narrow)])
            fit = ahead[c:] == ahead[: n - c + 1]
        selector[: n - c + 1][fit] = s
    # one number up to 60 bits wide has no selector of its own here: it takes the escape
    step = COUNTS[selector].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    chosen = selector[starts]
    size = 1 + (chosen == 0)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(chosen):
        rows = chosen == s
        first, at = starts[rows], place[rows]
        if s == 0:
            words[at + 1] = ids[first]
            continue
        word = np.full(len(first), int(s) << 60, np.uint64)
        for k in range(int(COUNTS[s]) if BITS[s] else 0):
            word |= ids[first + k] << np.uint64(k * int(BITS[s]))
        words[at] = word
    return words


def unpack_block(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block; every selector's words are taken apart together."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == 0).any():  # the word behind an escape is no word of its own
        zero = selector == 0
        at, escaped = 0, np.zeros(len(words), bool)
        for i in np.flatnonzero(zero):
            if i >= at:
                if i + 1 < len(words):
                    escaped[i + 1] = True
                at = i + 2
        heads = np.flatnonzero(~escaped)
    else:
        heads = np.arange(len(words))
    chosen = selector[heads]
    counts = COUNTS[chosen]
    place = np.cumsum(counts) - counts
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s == 0:
            out[place[rows]] = words[heads[rows] + 1]
        elif BITS[s]:
            shift = np.arange(int(COUNTS[s]), dtype=np.uint64) * np.uint64(BITS[s])
            values = (words[heads[rows], None] >> shift) & np.uint64((1 << int(BITS[s])) - 1)
            out[place[rows, None] + np.arange(int(COUNTS[s]))] = values
    return out


def write_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """Header, document table (id, id there or not, count), block table (first word of each block), words."""
    blocks = [pack_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = np.array([len(doc_ids), len(ids), BLOCK, len(blocks)], "<u8").tobytes()
    there = np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    table = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + there + np.array(counts, "<u8").tobytes()
    return b"".join([MAGIC, head, table, offsets.tobytes(), *[b.astype("<u8").tobytes() for b in blocks]])


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, Iterator[np.ndarray]]:
    """Document ids, counts, and the ids block by block."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_ids, block, n_blocks = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
    at = 40
    doc_ids = np.frombuffer(data, "<i8", n_docs, at).tolist()
    there = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
    counts = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 17 * n_docs
    offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
    at += 8 * (n_blocks + 1)

    def blocks() -> Iterator[np.ndarray]:
        for k in range(n_blocks):
            words = np.frombuffer(data, "<u8", int(offsets[k + 1] - offsets[k]), at + 8 * int(offsets[k]))
            yield unpack_block(words, min(block, n_ids - k * block))

    return [d if t else None for d, t in zip(doc_ids, there, strict=True)], counts, blocks()


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


#: How the vocabulary's files of this kind normalise and cut a text, and the mark of a word's end.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

#: Small letters of alphabets whose lower-casing goes letter by letter and which NFC leaves alone.
SMALL = "a-z\u00df-\u00f6\u00f8-\u00ff\u0100-\u012f\u0131-\u017f\u0400-\u045f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"
#: Characters that are neither those letters, their capitals nor plain digits, signs and white space.
ODD = re.compile(f"[^\x00-\x1b\x20-\x7f\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u00de\u00f7\u2010-\u2027\u2030-\u205e{SMALL}]")
PLAIN_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{SMALL}]+|[0-9]|[^\s{SMALL}0-9]+")
PLAIN_WORD_OR_END = re.compile(rf"{PLAIN_WORD.pattern}|\n")


def word_ranks(vocabulary: dict) -> dict[bytes, int] | None:
    """Ranks under which plain byte-pair merging gives a vocabulary's ids, a space standing for the end of a word.

    None unless the file normalises, cuts and merges as expected here: each single byte stands before all merges, with
    and without the end of a word, and every merge gives the next id.
    """
    model, before = vocabulary["model"], (vocabulary.get("pre_tokenizer") or {}).get("pretokenizers") or []
    cuts = [
        {"type": "Split", "pattern": {"Regex": WORD}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]
    others = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
    if vocabulary.get("normalizer") != NORMALIZER or before != cuts or model["type"] != "BPE":
        return None
    if model.get("end_of_word_suffix") != WORD_END or any(model.get(o) for o in others):
        return None
    as_byte = printable_bytes()
    special = {t["content"] for t in vocabulary["added_tokens"]}

    def key(token: str) -> bytes:
        body = token.removesuffix(WORD_END)
        return bytes(as_byte[c] for c in body) + (b" " if body != token else b"")

    ranks = {key(t): i for t, i in model["vocab"].items() if t not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(a + b) for a, b in pairs]
    alone = all(ranks.get(bytes([b]) + end, 512) < 512 for b in range(256) for end in (b"", b" ") if b != 32 or not end)
    return ranks if alone and made == list(range(512, 512 + len(pairs))) and len(ranks) == 512 + len(pairs) else None


class WordEncoder:
    """The library's ids of texts, as 32-bit numbers.

    With a vocabulary that ``word_ranks`` knows, normalising and cutting never look across white space, so a text is
    the sequence of its runs without any, and the distinct runs of many texts are encoded once. Words of plain runs
    are cut here and merged in one go, an end mark behind each; runs with other characters go to the library one
    by one. With any other vocabulary the library encodes whole texts.
    """

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, parsed = Tokenizer.from_str(vocabulary), json.loads(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = parsed["added_tokens"]
        # runs in which such a token may stand go to the library
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added) or "(?!)")
        bound = any(t["content"].split() != [t["content"]] or any(t.get(o) for o in ("lstrip", "rstrip", "single_word", "normalized")) for t in added)
        ranks = None if bound else word_ranks(parsed)
        self.words = ranks and tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        # no word holds a line feed, so its id tells where a run ends
        self.line_end = ranks and ranks[b"\n "]

    def by_library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def is_plain(self, text: str) -> bool:
        return not ODD.search(text) and not self.special.search(text)

    def encode_runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and of each run the place of its first id among them and their number."""
        text, odd = self.lines(runs), {}
        if not self.is_plain(text):
            odd = {i: self.by_library(r) for i, r in enumerate(text.split("\n")[:-1]) if not self.is_plain(r)}
            text = "\n".join(["" if i in odd else r for i, r in enumerate(text.split("\n"))])
        ids = self.words.encode_to_numpy(" ".join(PLAIN_WORD_OR_END.findall(text.lower())) + " " if text else "").astype("<u4", copy=False)
        ends = np.flatnonzero(ids == self.line_end)
        starts = np.concatenate([[0], ends + 1])[:-1]
        counts = ends - starts
        if odd:
            at, own = list(odd), np.array([len(x) // 4 for x in odd.values()], np.int64)
            starts[at], counts[at] = len(ids) + np.cumsum(own) - own, own
            ids = np.concatenate([ids, np.frombuffer(b"".join(odd.values()), "<u4")])
        return ids, starts, counts

    @staticmethod
    def lines(runs: pa.Array) -> str:
        """The runs, a line feed behind each."""
        whole = pa.LargeListArray.from_arrays(pa.array([0, len(runs)], pa.int64()), runs)
        return pc.binary_join(whole, pa.scalar("\n", runs.type))[0].as_py() + "\n" if len(runs) else ""

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of each text; a null text has none."""
        if self.words is None:
            return [self.by_library(t or "") for t in texts.to_pylist()]
        runs = pc.ascii_split_whitespace(texts.fill_null(""))
        distinct = runs.flatten().dictionary_encode()
        ids, starts, counts = self.encode_runs(distinct.dictionary)
        run = distinct.indices.to_numpy()
        sizes = counts[run]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(starts[run] - ends[:-1], sizes)
        places += np.arange(len(places))
        bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(runs).to_numpy())])].tolist()
        ids = ids[places]
        return [ids[a:b].tobytes() for a, b in pairwise(bounds)]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]


def portions(texts: pa.Array) -> Iterator[slice]:
    """Runs of texts of about ``PORTION`` bytes, so what is cut from them stays small in memory."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())
    start = 0
    while start < len(ends):
        end = int(np.searchsorted(ends, PORTION + (ends[start - 1] if start else 0))) + 1
        yield slice(start, end)
        start = end


_encoders: dict[int, WordEncoder] = {}


def write_tokens(
    docs: DataFrame, vocabulary_path: str, end_id: int, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> tuple[str, DataFrame]:
    """Encode all texts and write their ids in ascending order of ``id_column``; return the folder and its manifest.

    The documents are dealt out by ranges of their id and sorted there (equal ids by text, null ids first); each task
    writes one file, under a name of its own first and then under its final one, so an attempt that is lost or
    repeated leaves nothing half written. The manifest has a row for each file: file, n_docs, n_ids, start (ids
    of all files before it). A null text is an empty one: its document has the end id alone. An empty table gives no file.
    """
    spark = docs.sparkSession
    ship_package(spark)
    folder = folder or shared_folder(spark, "tokens")
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        claim("token files", _encoders.clear)
        key = hash(vocabulary.value)
        if key not in _encoders:
            _encoders[key] = WordEncoder(vocabulary.value)
        encoder, end = _encoders[key], np.array([end_id], "<u4").tobytes()
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        number, kept, held = 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, kept, held
            doc_ids = [d for d, _ in kept]
            counts = [len(x) // 4 for _, x in kept]
            pa.default_memory_pool().release_unused()  # what the portions took
            data = write_file(doc_ids, counts, np.frombuffer(b"".join([x for _, x in kept]), "<u4"))
            name = f"part-{TaskContext.get().partitionId():06d}-{number:06d}.s8b"
            own = f"{path}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(data)
            store.move(own, f"{path}/{name}")
            number, kept, held = number + 1, [], 0
            return pa.record_batch({"file": [name], "n_docs": [len(doc_ids)], "n_ids": [sum(counts)]})

        for batch in batches:
            for part in portions(batch.column(1)):
                for d, x in zip(batch.column(0)[part].to_pylist(), encoder.encode_all(batch.column(1)[part]), strict=True):
                    kept.append((d, x + end))
                    held += len(x)
                    if held >= 32_000_000:
                        yield flush()
        if kept:
            yield flush()

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = sorted(tuple(r) for r in ordered.mapInArrow(write, "file string, n_docs long, n_ids long").collect())
    start, manifest = 0, []
    for file, n_docs, n_ids in files:  # a row for each file of up to 8 million ids
        manifest.append((file, n_docs, n_ids, start))
        start += n_ids
    return folder, spark.createDataFrame(manifest, "file string, n_docs long, n_ids long, start long")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (binary)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, data = batch.column(0)[row].as_py(), batch.column(1)[row].as_buffer().to_pybytes()
                doc_ids, counts, blocks = read_file(data)
                ids = np.concatenate([np.zeros(0, "<u4"), *[b.astype("<u4") for b in blocks]]).astype("<u4")
                ends = np.cumsum(counts)
                parts = [ids[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)]
                columns = [
                    pa.array(doc_ids, pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(parts, pa.binary()))
                yield pa.record_batch(columns, names=[c.split()[0] for c in schema.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.s8b").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return named.join(F.broadcast(manifest), "file").select("start", "content").mapInArrow(read, schema)
