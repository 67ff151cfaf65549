"""Quality rules with line labels from a linear-chain conditional random field."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.common import WORDS, map_arrow

SYMBOLS = "#*$%&|<>"
_DROP_SYMBOLS = str.maketrans("", "", SYMBOLS)
WINDOW = 5
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: Most labelled documents the model is fitted on, and lines of a piece of a document in the fit (longer documents are cut in pieces).
SAMPLE_ROWS = 2_000
PIECE = 64
N_FEATURES = 12


def repeated(words: list[str]) -> np.ndarray:
    """For each word, whether it lies in a five-word window that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return np.zeros(len(words), bool)
    h = np.array(list(map(hash, words)), np.int64).astype(np.uint64)
    windows = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        x = h[k : k + n] * _MIX[k]
        windows += x ^ (x >> np.uint64(29))
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[WINDOW : WINDOW + n] -= twice
    return np.cumsum(edge[:-1]) > 0


def describe(text: str) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Base figures of a text, the features of its lines that hold a word, and their lengths in characters of words."""
    rows, sizes, seen = [], [], set()
    all_words: list[str] = []
    starts = []
    n_dup = word_chars = n_symbols = 0
    for line in text.split("\n"):
        words = WORDS.findall(line)
        if not words:
            continue
        again = line in seen
        seen.add(line)
        n_dup += again
        n, chars = len(words), sum(map(len, words))
        symbols = len(line) - len(line.translate(_DROP_SYMBOLS))
        n_symbols += symbols
        word_chars += chars
        starts.append(len(all_words))
        all_words += words
        sizes.append(chars)
        rows.append(
            (1.0, symbols / chars, line.count("!") / n, float(line.isupper()), chars / n / 10, 1 - len(set(words)) / n, float(again),
             math.log1p(n) / 5, float(words[-1][-1] in ".!?:;\"'"), float(words[0][0].isupper()), float(n < 3), 0.0)
        )
    features = np.array(rows, float).reshape(-1, N_FEATURES)
    twice = repeated(all_words)
    if len(rows):
        features[:, -1] = np.add.reduceat(twice.astype(float), starts) / np.diff([*starts, len(all_words)])
    base = {"n_words": len(all_words), "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": int(n_dup), "n_repeat_words": int(twice.sum())}
    return base, features, np.array(sizes, float)


@dataclass(frozen=True)
class LineModel:
    """Label 1 is content, 0 boilerplate: feature weights for 1 against 0, start weights, weights of neighbours."""

    weights: tuple[float, ...]
    start: tuple[float, float]
    moves: tuple[tuple[float, float], tuple[float, float]]


#: Without labels of both classes: symbols, exclamations, capitals and repeats speak against a line.
DEFAULT = LineModel((2.0, -12.0, -4.0, -3.0, 0.0, -1.0, -2.0, 0.0, 0.5, 0.0, -0.5, -4.0), (0.0, 0.0), ((1.0, 0.0), (0.0, 1.0)))


def label_lines(features: np.ndarray, model: LineModel) -> np.ndarray:
    """Viterbi: the likeliest labels of the lines together; ties go to content."""
    n = len(features)
    if not n:
        return np.zeros(0, bool)
    score = (features @ np.array(model.weights)).tolist()
    (m00, m01), (m10, m11) = model.moves
    v0, v1 = model.start[0], model.start[1] + score[0]
    back = []
    for s in score[1:]:
        to0, to1 = (v1 + m10 >= v0 + m00), (v1 + m11 >= v0 + m01)
        v0, v1 = (v1 + m10 if to0 else v0 + m00), (v1 + m11 if to1 else v0 + m01) + s
        back.append((to0, to1))
    label = v1 >= v0
    out = [label]
    for step in reversed(back):
        label = step[1] if label else step[0]
        out.append(label)
    return np.array(out[::-1], bool)


def fit_model(pieces: list[tuple[np.ndarray, int]], rounds: int = 120, ridge: float = 1e-3) -> LineModel:
    """Maximum likelihood of the labels of all lines given the features, by gradient steps on the exact gradient.

    The expected counts come from forward and backward passes over all pieces together.
    """
    if len({y for _, y in pieces}) < 2:
        return DEFAULT
    longest = max(len(x) for x, _ in pieces)
    n = len(pieces)
    x, there = np.zeros((n, longest, N_FEATURES)), np.zeros((n, longest), bool)
    y = np.array([label for _, label in pieces])
    for i, (f, _) in enumerate(pieces):
        x[i, : len(f)] = f
        there[i, : len(f)] = True
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))  # both classes weigh the same
    share = share / np.maximum(1, there.sum(1))
    theta = np.zeros(N_FEATURES + 6)
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def both(a: np.ndarray) -> np.ndarray:
        top = a.max(axis=-1, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=-1, keepdims=True)))[..., 0]

    for step in range(1, rounds + 1):
        w, start, moves = theta[:N_FEATURES], theta[N_FEATURES : N_FEATURES + 2], theta[N_FEATURES + 2 :].reshape(2, 2)
        emit = np.stack([np.zeros((n, longest)), x @ w], axis=-1)
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = start + emit[:, 0]
        for t in range(1, longest):
            new = both(ahead[:, t - 1, None, :] + moves.T[None]) + emit[:, t]
            ahead[:, t] = np.where(there[:, t, None], new, ahead[:, t - 1])
        behind = np.zeros((n, longest, 2))
        for t in range(longest - 2, -1, -1):
            new = both(moves[None] + (emit[:, t + 1] + behind[:, t + 1])[:, None, :])
            behind[:, t] = np.where(there[:, t + 1, None], new, 0.0)
        total = both(ahead[:, -1])
        at = np.exp(ahead + behind - total[:, None, None]) * there[..., None]
        gradient = np.zeros_like(theta)
        gradient[:N_FEATURES] = np.einsum("nt,ntk,n->k", (y[:, None] - at[..., 1]) * there, x, share)
        for label in (0, 1):
            gradient[N_FEATURES + label] = (share * ((y == label) - at[:, 0, label])).sum()
        pair = ahead[:, :-1, :, None] + moves[None, None] + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pair = np.exp(np.minimum(pair, 0)) * there[:, 1:, None, None]
        seen = np.zeros((2, 2))
        for label in (0, 1):
            seen[label, label] = (share * (y == label) * (there.sum(1) - 1)).sum()
        gradient[N_FEATURES + 2 :] = (seen - np.einsum("ntab,n->ab", pair, share)).ravel()
        gradient -= ridge * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    t = theta.tolist()
    k = N_FEATURES
    return LineModel(tuple(t[:k]), (t[k], t[k + 1]), ((t[k + 2], t[k + 3]), (t[k + 4], t[k + 5])))


def learn(
    docs: DataFrame, labels: DataFrame, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text", most_rows: int = SAMPLE_ROWS
) -> LineModel:
    """A line model from documents labelled good (1) or bad (0): their lines are content or boilerplate.

    At most ``most_rows`` labelled documents are used, half of each label if there are as many, those of smallest id
    hash; only the features of their lines reach the driver, in pieces of 64 lines, at most 5 pieces spread over a
    document. Rows without id, label or text take no part.
    """
    rows = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
    rows = rows.groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label_column).cast("int")).alias("label"))
    picked = None
    for label in (0, 1):
        part = rows.where((F.col("label") > 0) == bool(label)).orderBy(F.xxhash64("id"), "id").limit(most_rows // 2)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).where(F.col("text").isNotNull())
    sample = texts.join(F.broadcast(picked), "id").select("text", "label")

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, marks = [], []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            _, features, _ = describe(text)
            pieces = [features[i : i + PIECE] for i in range(0, len(features), PIECE)]
            for piece in pieces[:: max(1, -(-len(pieces) // 5))]:
                data.append(piece.astype("<f4").tobytes())
                marks.append(1 if label else 0)
        return pa.record_batch([pa.array(data, pa.binary()), pa.array(marks, pa.int64())], names=["x", "y"])

    found = map_arrow(sample, measure, "x binary, y long").collect()
    pieces = sorted((bytes(r["x"]), r["y"]) for r in found)
    return fit_model([(np.frombuffer(x, "<f4").reshape(-1, N_FEATURES).astype(float), y) for x, y in pieces])


def judge(docs: DataFrame, model: LineModel = DEFAULT, least_content: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Figures and verdict of every document.

    ``id_column``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than 10 words, or
    over a fifth of the words in repeated windows), kept (not base_failed and at least ``least_content`` of the
    characters of words in lines labelled content), content_share, line_labels (a string of c and b, one for each line
    with a word). A null or empty text has no words and fails. Null ids and repeated rows come back as they are.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {c: [] for c in [*names, "base_failed", "kept", "content_share", "line_labels"]}
        for text in batch.column(1).to_pylist():
            base, features, sizes = describe(text or "")
            content = label_lines(features, model)
            share = float(sizes[content].sum() / sizes.sum()) if len(sizes) else 0.0
            failed = base["n_words"] < 10 or 100 * base["n_repeat_words"] > 20 * base["n_words"]
            for c in names:
                out[c].append(base[c])
            out["base_failed"].append(failed)
            out["kept"].append(not failed and share >= least_content)
            out["content_share"].append(share)
            out["line_labels"].append("".join("c" if c else "b" for c in content))
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64(), pa.string()]
        return pa.record_batch([batch.column(0), *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], names=["id", *out])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, kept boolean, content_share double, line_labels string"
    return map_arrow(rows, step, schema).withColumnRenamed("id", id_column)
