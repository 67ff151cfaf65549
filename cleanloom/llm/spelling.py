"""Spelling variants: words one code point apart, found by PartEnum signatures of their letter multisets."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.bpe import slices
from cleanloom.llm.common import ASCII_LOWER, map_arrow
from cleanloom.session import cut, ship_package

#: Fixed by the contract: letters of a run, the divisor of damaged runs.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
DAMAGED = 199
LEAST_LETTERS, LEAST_OCCURRENCES, FORM_FACTOR = 6, 5, 5
#: Parts of the binary vector; a signature leaves out two of them. More parts give more rows and fewer candidates.
PARTS = 4
#: Occurrences of a letter that get a part of their own choice; later ones take these parts in turn.
OCCURRENCES = 4
#: Distinct words that a task adds up before it hands them on.
HELD = 300_000


def counted_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_letters: int = LEAST_LETTERS, least_n: int = LEAST_OCCURRENCES) -> DataFrame:
    """word, n: the runs of letters of all texts, a few of them damaged, with their occurrences.

    A run is lower-cased (A-Z only); where 199 divides the crc32 h of ``<id>:<run>`` it loses code point h % length.
    Words of fewer letters or occurrences are left out. Null texts have no runs; a null id counts as empty text;
    repeated rows count as often as they stand. Tasks add up their words before the shuffle.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not text:
                        continue
                    text = text.lower() if text.isascii() else text.translate(ASCII_LOWER)
                    before = zlib.crc32(f"{name or ''}:".encode())
                    for word, n in Counter(RUN.findall(text)).items():
                        if len(word) < least_letters:
                            continue
                        h = zlib.crc32(word.encode(), before)
                        if h % DAMAGED == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                            if len(word) < least_letters:
                                continue
                        total[word] += n
                if len(total) > HELD:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text"))
    counted = rows.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def balanced_parts(words: DataFrame, parts: int = PARTS) -> np.ndarray:
    """The part of each dimension (letter, occurrence), so that the parts hold about as many letters of the words.

    The counts have a row for each letter of the alphabet and occurrence: at most 256 times ``OCCURRENCES``. Any choice
    of parts gives the same pairs, so overlong words are not counted for it.
    """
    words = words.where(F.char_length("word") <= 64)
    code = F.transform(F.split("word", ""), lambda c: F.ascii(c))
    occurrence = F.transform(code, lambda c, i: F.pmod(F.size(F.filter(F.slice(code, 1, i + 1), lambda d: d == c)) - 1, F.lit(OCCURRENCES)))
    seen = words.select(F.explode(F.arrays_zip(code.alias("c"), occurrence.alias("k"))).alias("x")).groupBy("x.c", "x.k").count()
    out, load = np.tile(np.arange(OCCURRENCES) % parts, (256, 1)), np.zeros(parts)
    for c, k, n in sorted(map(tuple, seen.collect()), key=lambda r: (-r[2], r[0], r[1])):
        out[c % 256, k] = load.argmin()
        load[out[c % 256, k]] += n
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(words: list[str], part_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, the number of the word of each, and whether it stands as the longer word of a pair.

    The vector of a word has a dimension for each letter and occurrence (the second e is not the first). Words one code
    point apart differ in two dimensions at most, so of ``parts`` parts they agree in all but two: a signature is the
    content of the others, with which they are. Such words also share their first half or their last, of the
    length of the shorter one, which is part of the key: a word signs once with its length and once with one less.
    """
    parts = int(part_of.max()) + 1
    lengths = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    starts = np.cumsum(lengths) - lengths
    order = np.lexsort((codes, owner))
    run = np.r_[True, (np.diff(codes[order]) != 0) | (np.diff(owner[order]) != 0)]
    first = np.maximum.accumulate(np.where(run, np.arange(len(codes)), 0))
    occurrence = np.arange(len(codes)) - first
    sorted_codes = codes[order]
    value = mix((sorted_codes * (1 << 24) + occurrence + 1).astype(np.uint64))
    part = part_of[sorted_codes % 256, occurrence % OCCURRENCES]
    content = [np.add.reduceat(np.where(part == p, value, np.uint64(0)), starts) for p in range(parts)]
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    ahead = np.r_[np.uint64(0), np.cumsum(mix((codes * (1 << 32) + place + 1).astype(np.uint64)))]
    back = np.repeat(lengths, lengths) - 1 - place
    behind = np.r_[np.uint64(0), np.cumsum(mix((codes * (1 << 32) + back + 1).astype(np.uint64)))]
    keys, owners, longer = [], [], []
    for long in (False, True):
        shorter = lengths - int(long)
        half = shorter // 2
        halves = (ahead[starts + half] - ahead[starts], behind[starts + lengths] - behind[starts + lengths - half])
        for side, affix in enumerate(halves):
            for number, kept in enumerate(combinations(range(parts), max(1, parts - 2))):
                total = sum(content[p] for p in kept)
                label = (shorter * 2048 + number * 2 + side).astype(np.uint64)
                keys.append(mix(mix(total + label * np.uint64(0x9E3779B97F4A7C15)) ^ affix))
                owners.append(np.arange(len(words)))
                longer.append(np.full(len(words), long))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(longer)


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """a, n_a, b, n_b: each two words (distinct, with their n) that are one inserted, deleted or replaced code point apart, once.

    The signatures are joined as they are and each candidate is verified, so none is lost. Both sides of the join may be
    split where many words share a signature.
    """
    part_of = balanced_parts(words, parts)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if w]
        if not rows:
            return None
        signed = [(*signatures([w for w, _ in rows[s]], part_of), s.start) for s in slices([w for w, _ in rows], 1_000_000)]
        keys, longer = np.concatenate([k for k, _, _, _ in signed]), np.concatenate([x for _, _, x, _ in signed])
        owners = np.concatenate([o + at for _, o, _, at in signed])
        return pa.record_batch(
            [
                pa.array(keys.view(np.int64)), pa.array([w for w, _ in rows], pa.string()).take(pa.array(owners)),
                pa.array([n for _, n in rows], pa.int64()).take(pa.array(owners)), pa.array(longer),
            ],
            names=["key", "word", "n", "longer"],
        )

    signed = map_arrow(words.select("word", "n"), step, "key long, word string, n long, longer boolean")
    left = signed.where("NOT longer").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = signed.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
    met = left.join(right, "key").where((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def follow(forms: DataFrame) -> DataFrame:
    """word, root from word, form (not null): forms followed to the last, by joining the table with itself.

    A form is used five times as often as its word, so the chains are short and the joins few.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = cut(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_letters: int = LEAST_LETTERS, least_n: int = LEAST_OCCURRENCES,
    factor: int = FORM_FACTOR, parts: int = PARTS,
) -> DataFrame:
    """The words of all texts with the form each is a spelling of: word, n, n_near, form, form_n, root.

    Words as :func:`counted_words` has them. ``n_near``: words one code point apart. ``form``: the one of them with the
    largest n (of equals the smallest in code-point order) if that is ``factor`` times the word's n or more, else
    null. ``root``: forms followed to the last, the word itself without form. Empty tables, and tables of null or
    short texts, give no rows; other columns of ``docs`` are not looked at.
    """
    words = cut(counted_words(docs, id_column, text_column, least_letters, least_n))
    pairs = cut(near_pairs(words, parts))
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n"))
    )
    near = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    rows = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= factor * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    roots = follow(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
