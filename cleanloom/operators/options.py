"""Options of a preparation step: what to fit, in how many passes, and how to apply it.

An option never touches a DataFrame: it declares statistics and a column expression. ``run`` fits and applies many
options at once, so all features, options and variants share one pass over the data per fitting step.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.operators.local import Local, unchanged
from cleanloom.plans.grouping import Grouping
from cleanloom.plans.stats import Stat

# (value column, name prefix) -> statistics; later passes may use the columns of earlier ones
Pass = Callable[[Column, str], dict[str, Stat]]


@dataclass(frozen=True)
class Option:
    """``apply`` gets the value and the name prefix. ``model`` names a filling that is no column expression: a chain that
    begins with it starts from a column filled beforehand. ``local`` does the same on arrays within a task, where it is known."""

    name: str
    passes: Sequence[Pass] = field(default_factory=tuple)
    apply: Callable[[Column, str], Column] = lambda x, prefix: x
    model: str = ""
    local: Local | None = None


IDENTITY = Option("identity", local=unchanged)


def run(
    df: DataFrame, g: Grouping, work: Mapping[str, tuple[str, Option]], is_train: Column | None = None
) -> DataFrame:
    """Set each column of ``work`` to an option applied to a source column: ``{new column: (source, option)}``."""
    depth = max((len(o.passes) for _, o in work.values()), default=0)
    if depth > 1:
        return g.each(df, lambda rows, part: _run(rows, part, work, is_train, depth))
    return _run(df, g, work, is_train, depth)


def _run(df: DataFrame, g: Grouping, work: Mapping[str, tuple[str, Option]], is_train: Column | None, depth: int):
    train = F.lit(True) if is_train is None else is_train
    helpers: list[str] = []
    out = df
    for level in range(depth):
        specs: dict[str, Stat] = {}
        for i, (source, option) in enumerate(work.values()):
            if level < len(option.passes):
                found = option.passes[level](F.col(source), f"_o{i}")
                specs.update({n: s.only(train) for n, s in found.items()})
        out = g.with_stats(out, specs)
        helpers += list(specs)
    applied = {
        name: option.apply(F.col(source), f"_o{i}") for i, (name, (source, option)) in enumerate(work.items())
    }
    return out.withColumns(applied).drop(*helpers)
