"""Learned option probabilities per feature (R4): descent on the validation loss of a mixture of options.

A feature of the mixture is the sum of its option columns weighted by their probabilities, so it is linear in them. The
ridge model of the mixture, its validation loss and the gradient of that loss through the closed-form model all follow
from the sums of products of all option columns. The data is read once; what is learned per key works on these sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.operators.search import PENALTY, SPLITS, Chain, chain_name, solve_by_key
from cleanloom.plans.grouping import Grouping

# fixed values: the most steps and the first step length; a key stops by itself when no shorter step lowers its loss
STEPS, RATE = 2000, 0.1
SHORTEST = 1e-6
TOLERANCE = 1e-9


@dataclass(frozen=True)
class Sums:
    """Moments of all option columns about the training means: products, products with the target, its squares, rows."""

    xx: np.ndarray
    xy: np.ndarray
    yy: float
    n: float

    @classmethod
    def about(cls, gram: np.ndarray, means: np.ndarray) -> Sums:
        """From a Gram matrix of (1, options, target)."""
        change = np.eye(len(gram))
        change[1:, 0] = -means
        c = change @ gram @ change.T
        return cls(c[1:-1, 1:-1], c[1:-1, -1], float(c[-1, -1]), max(float(c[0, 0]), 1.0))

    def loss(self, u: np.ndarray) -> float:
        return max(0.0, (self.yy - 2 * self.xy @ u + u @ self.xx @ u) / self.n)


def weights(p: np.ndarray, train: Sums, penalty: float = PENALTY) -> np.ndarray:
    """Slopes of the ridge model on the mixture features; ``p`` is (features, options)."""
    a = spread(p)
    return np.linalg.solve(a @ train.xx @ a.T + penalty * np.eye(len(p)), a @ train.xy)


def spread(p: np.ndarray) -> np.ndarray:
    """The matrix that makes mixture features from all option columns."""
    d, m = p.shape
    out = np.zeros((d, d * m))
    for f in range(d):
        out[f, f * m : (f + 1) * m] = p[f]
    return out


def loss_and_gradient(logits: np.ndarray, train: Sums, val: Sums, penalty: float = PENALTY) -> tuple[float, np.ndarray]:
    """The validation loss of the model fitted to the mixture, and its gradient in the logits of the probabilities."""
    p, a = softmax(logits), spread(softmax(logits))
    d, m = p.shape
    s = a @ train.xx @ a.T + penalty * np.eye(d)
    w = np.linalg.solve(s, a @ train.xy)
    u = a.T @ w
    by_u = 2 * (val.xx @ u - val.xy) / val.n
    adjoint = np.linalg.solve(s, a @ by_u)
    whole = np.outer(w, by_u - train.xx @ (a.T @ adjoint)) + np.outer(adjoint, train.xy - train.xx @ u)
    by_p = np.stack([whole[f, f * m : (f + 1) * m] for f in range(d)])
    return val.loss(u), p * (by_p - (p * by_p).sum(axis=1, keepdims=True))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def descend(logits: np.ndarray, train: Sums, val: Sums, steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, list[float]]:
    """Logits after steps that each lower the loss, and the losses on the way; a step that does not is halved."""
    loss, slope = loss_and_gradient(logits, train, val)
    losses = [loss]
    for _ in range(steps):
        size = np.abs(slope).max()
        if size <= 1e-14:
            break
        rate = min(2 * rate, 10.0)
        while rate > SHORTEST:
            there = logits - rate * slope / size
            new, new_slope = loss_and_gradient(there, train, val)
            if new < loss:
                break
            rate /= 2
        else:
            break
        gained, logits, loss, slope = loss - new, there, new, new_slope
        losses.append(loss)
        if gained <= TOLERANCE * max(loss, 1e-12):
            break
    return logits, losses


def learn_probabilities(
    df: DataFrame,
    keys: Sequence[str] | Grouping,
    features: Sequence[str],
    target: str,
    chains: Sequence[Chain],
    row_id: Sequence[str],
    start: int = 0,
    start_probability: float = 0.5,
    split: str = "split",
    steps: int = STEPS,
    target_as: str = "value",
) -> DataFrame:
    """R4. Probabilities of the options per key and feature, learned on the validation loss of the mixture.

    All features begin with ``start_probability`` for chain ``start``. One row per key: choices (the likeliest chain of each
    feature), probabilities (an array for each feature, in the order of ``chains``), start_val_loss, best_val_loss,
    best_tr_loss, best_test_loss of the mixture, choice_val_loss of the choices alone, and losses (on the way). Losses
    are in units of the standardised training target and never end above the start.
    """
    labels, d, m = [chain_name(c) for c in chains], len(features), len(chains)
    first = np.full((d, m), np.log((1 - start_probability) / max(1, m - 1))) if m > 1 else np.zeros((d, 1))
    first[:, start] = np.log(start_probability) if m > 1 else 0.0

    def learn(total: Mapping[str, np.ndarray]) -> dict[str, object]:
        means = total["train"][0, 1:] / max(total["train"][0, 0], 1.0)
        train, val, test = (Sums.about(total[s], means) for s in SPLITS)
        logits, losses = descend(first, train, val, steps)
        p = softmax(logits)
        u = spread(p).T @ weights(p, train)
        choice = p.argmax(axis=1)
        alone = np.eye(m)[choice]
        return {
            "start_val_loss": losses[0], "best_val_loss": losses[-1], "best_tr_loss": train.loss(u), "best_test_loss": test.loss(u),
            "choice_val_loss": val.loss(spread(alone).T @ weights(alone, train)), "choices": [labels[o] for o in choice],
            "probabilities": [list(map(float, row)) for row in p], "losses": losses,
        }

    columns = (
        "start_val_loss double, best_val_loss double, best_tr_loss double, best_test_loss double, choice_val_loss double, "
        "choices array<string>, probabilities array<array<double>>, losses array<double>"
    )
    return solve_by_key(df, keys, features, target, chains, row_id, learn, columns, split, target_as)


def probability_log(result: DataFrame, keys: Sequence[str], features: Sequence[str], chains: Sequence[Chain]) -> DataFrame:
    """A row per key, feature and option: keys, feature, option, probability, chosen; in the order of the options."""
    names = F.array(*[F.lit(chain_name(c)) for c in chains])
    rows = result.select(*keys, "choices", F.posexplode("probabilities").alias("_f", "_p"))
    rows = rows.select(*keys, at(features, F.col("_f")).alias("feature"), F.element_at("choices", F.col("_f") + 1).alias("_choice"), F.explode(F.arrays_zip(names.alias("option"), F.col("_p").alias("probability"))).alias("_o"))
    return rows.select(*keys, "feature", F.col("_o.option").alias("option"), F.col("_o.probability").alias("probability"), (F.col("_o.option") == F.col("_choice")).alias("chosen"))


def at(names: Sequence[str], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), place + 1)
