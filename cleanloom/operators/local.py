"""Options within a task: statistics of the training rows of several whole groups at once, on numpy arrays.

They say the same as the declared statistics and column expressions of an option; missing values are NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np


class Groups:
    """Groups whose rows lie between ``ends``, with their training rows."""

    def __init__(self, ends: np.ndarray, train: np.ndarray):
        self.ends, self.count = ends, len(ends) - 1
        self.owner = np.repeat(np.arange(self.count), np.diff(ends))
        self.train = np.flatnonzero(train)
        self.of_train = self.owner[self.train]
        self.trained = np.bincount(self.of_train, minlength=self.count)

    def parts(self) -> list[slice]:
        return [slice(a, b) for a, b in zip(self.ends[:-1], self.ends[1:], strict=True)]

    def seen(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training values, the group of each, and how many each group has."""
        v = x[self.train]
        gone = np.isnan(v)
        if not gone.any():
            return v, self.of_train, self.trained
        owner = self.of_train[~gone]
        return v[~gone], owner, np.bincount(owner, minlength=self.count)

    def mean(self, x: np.ndarray) -> np.ndarray:
        v, owner, n = self.seen(x)
        return _share(np.bincount(owner, v, self.count), n)

    def std(self, x: np.ndarray) -> np.ndarray:
        v, owner, n = self.seen(x)
        gap = v - _share(np.bincount(owner, v, self.count), n)[owner]
        return np.sqrt(_share(np.bincount(owner, gap * gap, self.count), n))

    def least(self, x: np.ndarray, of: np.ufunc = np.minimum) -> np.ndarray:
        v, _, n = self.seen(x)
        out, some = np.full(self.count, np.nan), n > 0
        if some.any():
            out[some] = of.reduceat(v, (np.cumsum(n) - n)[some])
        return out

    def largest(self, x: np.ndarray) -> np.ndarray:
        return self.least(x, np.maximum)

    def in_order(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training values in rising order within each group, where those of a group begin, and how many they are."""
        v, _, n = self.seen(x)
        first = np.cumsum(n) - n
        for a, b in zip(first, first + n, strict=True):
            v[a:b].sort()
        return v, first, n

    def quantiles(self, x: np.ndarray, shares: Sequence[float]) -> list[np.ndarray]:
        """Exact quantiles, interpolated as Spark's percentile does."""
        v, first, n = self.in_order(x)
        some, out = n > 0, []
        for share in shares:
            at = share * (n[some] - 1)
            low, high = np.floor(at), np.ceil(at)
            a, b = v[first[some] + low.astype(np.int64)], v[first[some] + high.astype(np.int64)]
            found = np.full(self.count, np.nan)
            found[some] = np.where(a == b, a, (high - at) * a + (at - low) * b)
            out.append(found)
        return out

    def mode(self, x: np.ndarray) -> np.ndarray:
        """The most frequent value, the smallest one on ties."""
        v, first, n = self.in_order(x)
        out = np.full(self.count, np.nan)
        for g in np.flatnonzero(n):
            own = v[first[g] : first[g] + n[g]]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[g] = own[starts[np.argmax(np.diff(np.r_[starts, len(own)]))]]
        return out

    def below(self, x: np.ndarray, bins: int) -> np.ndarray:
        """How many cut points of ``bins`` equally filled bins lie below each value."""
        v, first, n = self.in_order(x)
        out = np.zeros(len(x))
        for g, part in enumerate(self.parts()):
            step = max(1, round(n[g] / bins))
            out[part] = np.searchsorted(v[first[g] + step - 1 : first[g] + n[g] - 1 : step], x[part], side="left")
        return out


Local = Callable[[np.ndarray, Groups], np.ndarray]


def _share(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, total / np.maximum(n, 1), np.nan)


def unchanged(x: np.ndarray, groups: Groups) -> np.ndarray:
    return x


def filled(statistic: Callable[[Groups, np.ndarray], np.ndarray]) -> Local:
    return lambda x, groups: np.where(np.isnan(x), statistic(groups, x)[groups.owner], x)


def can_run(chains: Mapping[str, tuple[str, Sequence]], models: Mapping[str, object]) -> bool:
    """Whether every option of the chains is known within a task."""
    return all(o.local is not None and (not o.model or o.model in models) for _, chain in chains.values() for o in chain)


def apply_chains(
    values: Mapping[str, np.ndarray], fills: Mapping[tuple[str, str], np.ndarray], groups: Groups, chains: Mapping[str, tuple[str, Sequence]]
) -> dict[str, np.ndarray]:
    """The column of every chain ``{new column: (source, options in order)}``; common beginnings are worked out once.

    ``fills`` holds the model fillings by model and source.
    """
    made: dict[tuple, np.ndarray] = {}
    out = {}
    for new, (source, chain) in chains.items():
        x = values[source]
        for i, option in enumerate(chain):
            prefix = (source, *[o.name for o in chain[: i + 1]])
            if prefix not in made:
                before = fills[option.model, source] if option.model else x
                made[prefix] = option.local(before, groups)
            x = made[prefix]
        out[new] = x
    return out
