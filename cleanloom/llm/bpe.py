"""Byte-pair encoding over a trie of distinct words, and decoding."""

from __future__ import annotations

import hashlib
import json
from array import array
from os.path import commonprefix

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.common import claim, map_arrow

#: Fixed value: how byte-level vocabularies cut a text into words.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: A blank before white space, where a cut at blanks would not be a cut between words.
UNSAFE = regex.compile(r" (?=\p{White_Space}|$)")
#: Chunks and token pairs whose answers a task remembers at most; the memory is emptied beyond, nothing is dropped.
REMEMBERED = 600_000


def printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encodes as the merges of a byte-level vocabulary file do.

    A token sequence is the encoding of its bytes exactly if each token and each pair of neighbours encodes to
    itself. So the encoding of a prefix is known from its last token, and the last token of a longer prefix is the one
    that fits behind the last token where it starts. Distinct words are put in a trie; a depth-first walk hands each
    node the last tokens on its path, so a shared prefix is worked out once.
    """

    def __init__(self, vocabulary: str):
        model = json.loads(vocabulary)
        as_byte = printable_bytes()
        to_bytes = lambda s: bytes(as_byte[c] for c in s)
        self.ids = {to_bytes(s): i for s, i in model["model"]["vocab"].items()}
        self.rank = {}
        for r, pair in enumerate(model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[to_bytes(left), to_bytes(right)] = r
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.made_by: dict[bytes, tuple[int, tuple[bytes, bytes]]] = {}
        for pair, r in self.rank.items():
            self.made_by.setdefault(pair[0] + pair[1], (r, pair))
        #: With one merge for each token, the history of a token is known without running its merges.
        self.plain = len(self.made_by) == len(self.rank) and all(self.merged(t) == [t] for t in self.made_by)
        self.rank_of_ids = {self.ids[a] << 32 | self.ids[b]: r for (a, b), r in self.rank.items()}
        self.spines: tuple[dict, dict] = ({}, {})
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.link_suffixes()

    def link_suffixes(self) -> None:
        """Which tokens end at a byte: states are prefixes of tokens, each with its longest proper suffix that is one too."""
        self.step: dict[int, int] = {}
        depths: list[list[tuple[int, int, int]]] = []
        own, tokens = [-1], sorted(self.ids)
        for token in tokens:
            state = 0
            for depth, byte in enumerate(token):
                key = state << 8 | byte
                if key not in self.step:
                    self.step[key] = len(own)
                    own.append(-1)
                    if depth == len(depths):
                        depths.append([])
                    depths[depth].append((state, byte, self.step[key]))
                state = self.step[key]
            own[state] = self.ids[token]
        self.fall, self.token_at = [0] * len(own), own
        self.shorter, self.length = {}, {i: len(b) for b, i in self.ids.items()}
        for level in depths:
            for state, byte, to in level:
                if state:
                    at = self.fall[state]
                    while at and at << 8 | byte not in self.step:
                        at = self.fall[at]
                    self.fall[to] = self.step.get(at << 8 | byte, 0)
                if own[to] >= 0:
                    self.shorter[own[to]] = own[self.fall[to]]
                else:
                    own[to] = own[self.fall[to]]

    def merged(self, word: bytes) -> list[bytes]:
        """The merges applied as defined, lowest rank first; for the short strings that settle a pair of tokens."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            pair, out, i = (parts[best], parts[best + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of a token that lie at its right (1) or left (0) edge while it is merged, each with the rank
        of the merge that ends it."""
        known = self.spines[side].get(token)
        if known is None:
            known, until = [], float("inf")
            part = self.bytes_of[token]
            while True:
                known.append((self.ids[part], until))
                if part not in self.made_by:
                    break
                until, pair = self.made_by[part]
                part = pair[side]
            self.spines[side][token] = known
        return known

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when encoded together; at the start of a word, left is -1.

        They do unless some merge across their border comes before the merges that end its two parts; among equal
        ranks the merge further left comes first.
        """
        if self.plain and left >= 0:
            rank = self.rank_of_ids
            known = not any(
                (r := rank.get(x << 32 | y)) is not None and r < ends_x and r <= ends_y
                for x, ends_x in self.spine(left, 1)
                for y, ends_y in self.spine(right, 0)
            )
        else:
            a, b = self.bytes_of.get(left, b""), self.bytes_of[right]
            known = self.merged(a + b) == ([a, b] if a else [b])
        self.fits[left << 32 | right] = known
        return known

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, as packed 32-bit numbers.

        Words in byte order are the trie in depth-first order: ``last`` holds the last token of every prefix on
        the open path, and going to the next word keeps it up to the branch.
        """
        out, before = {}, b""
        last, states = [-1], [0]
        step, fall, token_at, shorter, length, fits = self.step, self.fall, self.token_at, self.shorter, self.length, self.fits
        for raw, word in sorted([(w.encode(), w) for w in words]):
            shared = len(commonprefix((before, raw)))
            del last[shared + 1 :], states[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                byte, state = raw[end - 1], states[-1]
                to = step.get(state << 8 | byte)
                if to is None:
                    at = fall[state]
                    while (to := step.get(at << 8 | byte)) is None:
                        at = fall[at]
                states.append(to)
                token = token_at[to]
                while True:
                    left = last[end - length[token]]
                    fit = fits.get(left << 32 | token)
                    if fit or fit is None and self.follows(left, token):
                        break
                    token = shorter[token]
                last.append(token)
            tokens, end = [], len(raw)
            while end:
                tokens.append(last[end])
                end -= length[last[end]]
            tokens.reverse()
            out[word] = array("I", tokens).tobytes()
            before = raw
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; the strings of special tokens become their ids."""
        plain = [self.special_split.split(t) if self.special_split else [t] for t in texts]
        cut = [[p if p in self.special else self.cut(p) for p in parts if p] for parts in plain]
        for memory in (self.chunks, self.words, self.fits):
            if len(memory) > REMEMBERED:
                memory.clear()
        new = {c for parts in cut for p in parts if isinstance(p, list) for c in p if c not in self.chunks}
        pieces = {c: pieces_of(c) for c in new}
        words = self.words
        words.update(self.encode_words([w for w in {w for p in pieces.values() for w in p} if w not in words]))
        for c, p in pieces.items():
            self.chunks[c] = words[p[0]] if len(p) == 1 else b"".join([words[w] for w in p])
        get = self.chunks.__getitem__
        special = {s: array("I", [i]).tobytes() for s, i in self.special.items()}
        return [b"".join([special[p] if isinstance(p, str) else b"".join(map(get, p)) for p in parts]) for parts in cut]

    @staticmethod
    def cut(text: str) -> list[str]:
        """Cut before blanks; pieces end there anyway unless more white space follows."""
        if UNSAFE.search(text):
            return SPLIT.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + c for c in rest]] if first else [" " + c for c in rest]

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, array("I", packed))).decode("utf-8", "replace")


def pieces_of(chunk: str) -> list[str]:
    """Words of a chunk; a blank, letters and one mark need no pattern."""
    body = chunk[1:] if chunk[:1] == " " else chunk
    if body.isalpha():
        return [chunk]
    if body[-1:] in (".", ",", "!", "?", ";", ":") and body[:-1].isalpha():
        return [chunk[:-1], chunk[-1]]
    return SPLIT.findall(chunk)


_encoders: dict[int, TrieEncoder] = {}


def encoder(vocabulary: str) -> TrieEncoder:
    """One encoder per worker and vocabulary."""
    claim("bpe", _encoders.clear)
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TrieEncoder(vocabulary)
    return _encoders[key]


def slices(texts: list[str], chars: int = 2_000_000) -> list[slice]:
    """Runs of texts of about ``chars`` characters, so the cut pieces of a run stay small in memory."""
    out, start, total = [], 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            out.append(slice(start, i + 1))
            start, total = i + 1, 0
    return [*out, slice(start, len(texts))] if start < len(texts) else out


def encode(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token ids of every text: ``id_column``, ``ids`` (binary, little-endian unsigned 32-bit numbers).

    A null text encodes as an empty one; null ids and repeated rows come back as they are; an empty table gives an
    empty one. The vocabulary file is read where this is called and sent to the tasks.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        trie = encoder(vocabulary.value)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        ids = [x for s in slices(texts) for x in trie.encode_batch(texts[s])]
        return pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    out = map_arrow(docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")), step, f"id {kind}, ids binary")
    return out.withColumnRenamed("id", id_column)


def round_trip(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass: ``id_column``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        trie = encoder(vocabulary.value)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        counts, hashes, decoded = [], [], []
        for s in slices(texts):
            for packed in trie.encode_batch(texts[s]):
                counts.append(len(packed) // 4)
                hashes.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(trie.decode(packed).encode()).hexdigest())
        return pa.record_batch(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
            names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    out = map_arrow(rows, step, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_column)
