"""Linear models per group with cross-validated grids, all from one Gram pass (M1-M3)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.plans import gram as G

# fixed values: the grids, in search order (the first best combination wins)
ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
INTERCEPTS = (True, False)
TEST_PART = -1

RESULT = (
    "alpha double, fit_intercept boolean, cv_mse double, test_rmse double, n_train bigint, n_test bigint, "
    "coefficients array<double>"
)
# groups solved together; keeps the numpy temporaries of one batch small
BATCH = 512


def model_grid(model: str) -> list[tuple[float, bool]]:
    """(alpha, fit_intercept) candidates of a model."""
    if model == "ridge":
        return [(a, i) for a in ALPHAS for i in INTERCEPTS]
    if model == "lasso":
        return [(a, True) for a in ALPHAS]
    if model == "linear_regression":
        return [(0.0, i) for i in INTERCEPTS]
    raise ValueError(f"unknown linear model {model!r}")


def _search(parts: list[np.ndarray], test: np.ndarray, model: str, standardise: bool, date_dummies: bool) -> pd.DataFrame:
    total = sum(parts)
    if standardise:
        *parts, test, total = G.rescaled(total, [*parts, test, total])
    folds = np.stack(parts, axis=1)
    training = total[:, None] - folds
    solve = G.lasso if model == "lasso" else G.ridge
    # one indicator per row (a text date) acts like one more unit of ridge penalty
    extra = 1.0 if date_dummies else 0.0
    grid = model_grid(model)
    losses, weights = [], []
    for alpha, intercept in grid:
        fold_mse = G.mean_squared_error(folds, solve(training, alpha + extra, intercept))
        seen = ~np.isnan(fold_mse)
        losses.append(np.where(seen, fold_mse, 0).sum(1) / np.maximum(seen.sum(1), 1))
        weights.append(solve(total, alpha + extra, intercept))
    losses, weights = np.stack(losses, 1), np.stack(weights, 1)
    best = np.argmin(losses, axis=1)
    at = np.arange(len(best))
    usable = total[:, 0, 0] > 0
    chosen = weights[at, best]
    test_mse = G.mean_squared_error(test, chosen)
    return pd.DataFrame(
        {
            "alpha": [grid[b][0] for b in best],
            "fit_intercept": [grid[b][1] for b in best],
            "cv_mse": np.where(usable, losses[at, best], np.nan),
            "test_rmse": np.where(usable, np.sqrt(test_mse), np.nan),
            "n_train": np.rint(total[:, 0, 0]).astype(int),
            "n_test": np.rint(test[:, 0, 0]).astype(int),
            "coefficients": list(chosen),
        }
    )


def _searcher(folds: int, width: int, model: str, standardise: bool, date_dummies: bool) -> Callable:
    @F.pandas_udf(RESULT)
    def search(*columns: pd.Series) -> pd.DataFrame:
        packed = [G.stack(c, width) for c in columns]
        out = []
        for start in range(0, len(columns[0]), BATCH):
            *parts, test = [G.square(p[start : start + BATCH]) for p in packed]
            out.append(_search(parts, test, model, standardise, date_dummies))
        return pd.concat(out, ignore_index=True)

    return search


def grid_search(
    grams: DataFrame,
    keys: Sequence[str],
    n_features: int,
    model: str = "ridge",
    folds: int = 5,
    standardise: bool = True,
    date_dummies: bool = False,
) -> DataFrame:
    """Cross-validated grid search, refit and test score per key.

    ``grams`` has keys, ``part`` (fold number from 0, or TEST_PART) and ``gram``, at most folds + 1 rows per key.
    """
    width = (n_features + 2) * (n_features + 3) // 2
    model_grid(model)
    parts = [*range(folds), TEST_PART]
    names = [f"_g{i}" for i in range(len(parts))]
    wide = grams.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_part") == p, F.col("gram"))).alias(n) for p, n in zip(parts, names, strict=True)]
    )
    search = _searcher(folds, width, model, standardise, date_dummies)
    found = wide.select(*keys, search(*names).alias("_r")).select(*keys, "_r.*")
    return found.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("cv_mse", "test_rmse")})


def fit_linear(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    target: str,
    part: Column,
    model: str = "ridge",
    folds: int = 5,
    standardise: bool = True,
    date_dummies: bool = False,
) -> DataFrame:
    """M1-M3 in one call: rows without missing cells, ``part`` = fold number or TEST_PART."""
    grams = G.gram(df.withColumn("_part", part), [*keys, "_part"], [*features, target])
    return grid_search(grams, keys, len(features), model, folds, standardise, date_dummies)
