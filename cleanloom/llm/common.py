"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.session import cut, ship_package

#: White space of every operator: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
#: Lower case of A-Z only.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

#: A side is sent to every task only if its counted rows stay within this bound; beyond it the join shuffles.
SMALL_ROWS = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_or_shuffled(df: DataFrame, most: int = SMALL_ROWS, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its row count, taken here unless given, is within ``most``; else as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``step`` over the Arrow batches of ``df``. Batches are cut to 1,000 rows, so very long texts fit in memory."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                out = step(batch.slice(at, 1000))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


_holder: list = ["", None]


def claim(operator: str, forget: Callable[[], None]) -> None:
    """Say that the memory of this worker is ``operator``'s from here on.

    Workers are reused by later stages. What another operator keeps between tasks is given up by its ``forget`` then.
    """
    if _holder[0] != operator:
        if _holder[1] is not None:
            _holder[1]()
            gc.collect()
        _holder[:] = [operator, forget]


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that all executors share."""
    cut(spark.range(1))  # names the checkpoint folder of this session if none is set
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if base.startswith("file:/") and not base.startswith("file:///"):
        base = "file://" + base[5:]
    return f"{base}/{name}-{uuid.uuid4().hex}"


def lower_ascii(c: str | Column) -> Column:
    """Lower case of A-Z only. ``lower`` does just that where every character takes one byte."""
    c = F.col(c) if isinstance(c, str) else c
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))
