"""Toxicity: a weighted lexicon, learned from labels, matched after folding disguises."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.common import claim, map_arrow

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
}
#: Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown")
#: Most labelled rows that the lexicon is learned from.
SAMPLE_ROWS = 20_000
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Evidence a term needs, in nats: about a million terms are looked at, and chance should choose none of them.
EVIDENCE = math.log(1e6)


class Folding(dict):
    """For str.translate: letters in lower case with disguises undone; all else is a blank."""

    def __missing__(self, code: int) -> str:
        char = chr(code).lower()
        if len(char) > 1 or 0xFF01 <= code <= 0xFF5E:
            import unicodedata

            char = unicodedata.normalize("NFKC", char).lower()[:1]
        char = SUBSTITUTES.get(char) or HOMOGLYPHS.get(char) or (char if char.isalpha() else " ")
        self[code] = char
        return char


FOLDING = Folding()


def fold(text: str) -> str:
    """Lower-cased letters with one blank around; characters without width inside words vanish."""
    if not text.isascii():
        for hidden in ("​", "‌", "‍", "­", "﻿"):
            if hidden in text:
                text = text.replace(hidden, "")
    return f" {text.translate(FOLDING)} "


@dataclass(frozen=True)
class Lexicon:
    """Terms and their weights. A term starts with a blank (start of a word); with a blank at its end it is a whole word."""

    terms: dict[str, float]
    intercept: float
    slope: float
    exceptions: tuple[str, ...] = EXCEPTIONS


class Scorer:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.terms.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in lexicon.exceptions:
            term = fold(phrase)
            self.automaton.add_word(term, (len(term), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def strength(self, text: str) -> float:
        """Weights of all hits outside exception phrases, over the logarithm of the length in words."""
        if not len(self.automaton):
            return 0.0
        folded = fold(text)
        hits = [(end - size + 1, end, weight) for end, (size, weight) in self.automaton.iter(folded)]
        if not hits:
            return 0.0
        spans = [(a, b) for a, b, w in hits if w is None]
        total = sum(w for a, b, w in hits if w is not None and not any(x <= a and b <= y for x, y in spans))
        return total / math.log2(8 + len(folded.split()))

    def score(self, text: str) -> float:
        z = self.lexicon.intercept + self.lexicon.slope * self.strength(text)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


_scorers: dict[int, Scorer] = {}


def scorer(lexicon: Lexicon) -> Scorer:
    claim("toxicity", _scorers.clear)
    key = hash((tuple(sorted(lexicon.terms.items())), lexicon.intercept, lexicon.slope, lexicon.exceptions))
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(lexicon)
    return _scorers[key]


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 5, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def chosen_terms(counts: list[tuple[str, int, int]], positives: int, negatives: int) -> dict[str, float]:
    """Terms that mark label 1: in at least 2 % of its texts, and so much more there than elsewhere that it is no chance.

    Terms are taken by falling evidence, of equals the longest: a whole word where the word stands alone, a stem where
    many endings follow. What begins a taken term, or begins with it, is left out.
    """
    least, base = max(3, 0.02 * positives), positives / (positives + negatives)
    found = []
    for term, pos, neg in counts:
        weight = math.log((pos + 0.5) / (positives + 1)) - math.log((neg + 0.5) / (negatives + 1))
        share = pos / (pos + neg)
        evidence = pos * math.log(share / base) + (neg * math.log((1 - share) / (1 - base)) if neg else 0)
        if pos >= least and weight >= 2 and pos > neg and evidence >= EVIDENCE:
            found.append((-evidence, -len(term), term, weight))
    chosen: dict[str, float] = {}
    begun: set[str] = set()
    for _, _, term, weight in sorted(found):
        starts = [term[:n] for n in range(2, len(term) + 1)]
        if term not in begun and not any(x in chosen for x in starts):
            chosen[term] = weight
            begun.update(starts)
    return chosen


def learn(
    docs: DataFrame, labels: DataFrame, label_column: str = "toxic", id_column: str = "doc_id", text_column: str = "text", most_rows: int = SAMPLE_ROWS
) -> Lexicon:
    """A lexicon from labelled texts outside the held-out fold; texts that repeat count once.

    At most ``most_rows`` labelled rows are used, those of smallest id hash, so reruns agree. Rows without id, text or
    label take no part; of several labels of an id the largest holds. With one class only, every score is that
    class's share.
    """
    spark = docs.sparkSession
    rows = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & ~held_out(id_column))
    rows = rows.groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label_column).cast("int")).alias("label"))
    rows = rows.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).where(F.col("text").isNotNull())
    sample = texts.join(F.broadcast(rows), "id").groupBy(F.xxhash64("text").alias("h"), F.md5("text").alias("m")).agg(
        F.max("label").alias("label"), F.any_value("text").alias("text")
    ).select("text", "label").repartition(spark.sparkContext.defaultParallelism)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            terms = {""}
            for word in set(fold(text).split()):
                if len(word) > 2:
                    terms.add(f" {word} ")
                    terms.update(f" {word[:n]}" for n in PREFIXES if len(word) >= n)
            seen[1 if label else 0].update(terms)
        terms = list(seen[0].keys() | seen[1].keys())
        return pa.record_batch(
            [pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())],
            names=["term", "pos", "neg"],
        )

    counted = map_arrow(sample, count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # at most most_rows texts went in, and a term kept here is in three texts of label 1 and mostly in those
    kept = [tuple(r) for r in counted.where((F.col("term") == "") | (F.col("pos") >= 3) & (F.col("pos") > F.col("neg"))).collect()]
    positives, negatives = next(((p, n) for t, p, n in kept if t == ""), (0, 0))
    if not positives or not negatives:
        share = positives / max(1, positives + negatives)
        return Lexicon({}, math.log((share + 1e-3) / (1 - share + 1e-3)), 0.0)
    terms = chosen_terms([x for x in kept if x[0]], positives, negatives)
    plain = Lexicon(terms, 0.0, 1.0)

    def strengths(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Counter(
            (round(scorer(plain).strength(t), 2), 1 if y else 0) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        )
        return pa.record_batch({"x": [x for x, _ in found], "y": [y for _, y in found], "n": list(found.values())})

    grouped = map_arrow(sample, strengths, "x double, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).collect()
    x, y, n = (np.array([r[c] for r in grouped], float) for c in ("x", "y", "n"))
    design, weights = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):  # Newton steps of a logistic fit with a small ridge
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -500, 500)))
        slope = design.T @ (n * (y - p)) - 0.1 * weights
        weights += np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), slope)
    return Lexicon(terms, float(weights[0]), float(weights[1]))


def score(docs: DataFrame, lexicon: Lexicon, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` ids with held_out, score (0 to 1) and predicted (1 if score is 0.5 or more).

    Null and empty texts have no hits and the lowest score. Ids may be null or repeat; every row comes back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        judge = scorer(shared.value)
        return pa.record_batch([batch.column(0), batch.column(1), pa.array([judge.score(t or "") for t in batch.column(2).to_pylist()], pa.float64())], names=["id", "held_out", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), held_out(id_column).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    out = map_arrow(rows, step, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_column), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, lexicon: Lexicon, text_column: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``most``, unchanged."""
    shared, columns = docs.sparkSession.sparkContext.broadcast(lexicon), docs.schema
    place = docs.columns.index(text_column)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        judge = scorer(shared.value)
        return batch.filter(pa.array([judge.score(t or "") < most for t in batch.column(place).to_pylist()], pa.bool_()))

    return map_arrow(docs, step, columns)
