"""Sums of products as the one data pass behind all linear models.

For rows z = (1, x1..xd, y) the sums of z z' per (keys, part) are distributed, partially aggregated on the map side
and end as one short array per group. Every fold, penalty, intercept choice and test score is then arithmetic on
arrays of (d + 2)^2 numbers, done for many groups at once with numpy inside tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def product_sums(columns: Sequence[str | Column]) -> Column:
    """Aggregate: upper triangle of sum(z z') for z = (1, *columns), row by row. Rows must have no NULL in them."""
    z = [F.lit(1.0)] + [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.array(*[F.sum(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))])


def gram(df: DataFrame, keys: Sequence[str], columns: Sequence[str | Column], out: str = "gram") -> DataFrame:
    return df.groupBy(*keys).agg(product_sums(columns).alias(out))


def square(packed: np.ndarray) -> np.ndarray:
    """(B, m) upper triangles to (B, p, p) symmetric matrices."""
    p = int((np.sqrt(8 * packed.shape[1] + 1) - 1) / 2)
    rows, cols = np.triu_indices(p)
    full = np.zeros((packed.shape[0], p, p))
    full[:, rows, cols] = packed
    full[:, cols, rows] = packed
    return full


def stack(arrays, width: int) -> np.ndarray:
    """A pandas series of arrays to (B, width); a missing array counts as all zeros."""
    return np.stack([np.zeros(width) if a is None else np.asarray(a, dtype=float) for a in arrays])


def rescaled(total: np.ndarray, parts: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Bring Gram matrices to units in which each column of ``total`` has mean 0 and population deviation 1."""
    n = np.maximum(total[:, 0, 0], 1)[:, None]
    mean = total[:, 0, :] / n
    var = np.einsum("bii->bi", total) / n - mean**2
    # a constant column keeps its unit; rounding leaves a tiny variance behind
    spread = np.sqrt(np.where(var > 1e-12 * np.maximum(mean**2, 1e-300), var, 1.0))
    mean[:, 0], spread[:, 0] = 0.0, 1.0
    p = total.shape[1]
    change = np.zeros_like(total)
    change[:, range(p), range(p)] = 1 / spread
    change[:, 1:, 0] = -mean[:, 1:] / spread[:, 1:]
    return [change @ g @ change.transpose(0, 2, 1) for g in parts]


def centred(g: np.ndarray, intercept: bool) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y, about the means when an intercept is fitted."""
    xx, xy = g[..., 1:-1, 1:-1], g[..., 1:-1, -1]
    if not intercept:
        return xx, xy
    n = np.maximum(g[..., 0, 0], 1)
    sx, sy = g[..., 0, 1:-1], g[..., 0, -1]
    return xx - sx[..., :, None] * sx[..., None, :] / n[..., None, None], xy - sx * (sy / n)[..., None]


def with_intercept(g: np.ndarray, w: np.ndarray, intercept: bool) -> np.ndarray:
    """Coefficients (intercept first) from slopes."""
    n = np.maximum(g[..., 0, 0], 1)
    b = (g[..., 0, -1] - (g[..., 0, 1:-1] * w).sum(-1)) / n if intercept else np.zeros(w.shape[:-1])
    return np.concatenate([b[..., None], w], axis=-1)


def ridge(g: np.ndarray, alpha: float, intercept: bool) -> np.ndarray:
    """Ridge coefficients for a batch of Gram matrices; alpha 0 is least squares of minimum norm."""
    xx, xy = centred(g, intercept)
    if alpha == 0:
        w = (np.linalg.pinv(xx, rcond=1e-12, hermitian=True) @ xy[..., None])[..., 0]
    else:
        w = np.linalg.solve(xx + alpha * np.eye(xx.shape[-1]), xy[..., None])[..., 0]
    return with_intercept(g, w, intercept)


def lasso(g: np.ndarray, alpha: float, intercept: bool, rounds: int = 1000, tolerance: float = 1e-8) -> np.ndarray:
    """Lasso coefficients (penalty alpha on mean squared error / 2) by cyclic coordinate descent on the Gram matrix."""
    xx, xy = centred(g, intercept)
    n = np.maximum(g[..., 0, 0], 1)
    w = np.zeros_like(xy)
    diag = np.einsum("...ii->...i", xx)
    for _ in range(rounds):
        change = 0.0
        for j in range(w.shape[-1]):
            rho = xy[..., j] - (xx[..., j, :] * w).sum(-1) + diag[..., j] * w[..., j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - n * alpha, 0) / np.where(diag[..., j] > 0, diag[..., j], 1)
            change = max(change, float(np.abs(new - w[..., j]).max(initial=0)))
            w[..., j] = new
        if change < tolerance:
            break
    return with_intercept(g, w, intercept)


def mean_squared_error(g: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """Mean squared error of a linear model over the rows summed in g; NaN where there are none."""
    v = np.concatenate([-coefficients, np.ones((*coefficients.shape[:-1], 1))], axis=-1)
    sse = np.einsum("...i,...ij,...j->...", v, g, v)
    n = g[..., 0, 0]
    return np.where(n > 0, np.maximum(sse, 0) / np.maximum(n, 1), np.nan)
