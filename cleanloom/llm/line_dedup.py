"""Lines that many documents share, found by range-partitioned hashes and dropped by bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.llm.common import BLANKS, lower_ascii, small_or_shuffled, unused
from cleanloom.session import cut

LEAST_DOCUMENTS = 10


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, least_chars: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each line with a key: h1, h2 (hashes of the key), slot, doc_id, text_hash, line (from 0), first.

    The rows are dealt out by ranges of (h1, h2, slot) and sorted by document and line within; ``first`` marks the
    first line of a document with the key. ``slot`` is a hash of the document that cuts a key found everywhere into
    as many parts as there are shuffle partitions.
    """
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text_column).cast("string")).alias("text_hash"), F.posexplode(lines_of(text_column)).alias("line", "_text")
    )
    key = line_key(F.col("_text"))
    rows = rows.select("doc_id", "text_hash", "line", key.alias("_key")).where(F.char_length("_key") >= least_chars)
    rows = rows.select(
        F.xxhash64("_key").alias("h1"), F.hash("_key", F.lit("line")).alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("slot"), "doc_id", "text_hash", "line"
    )
    dealt = rows.repartitionByRange(slots, "h1", "h2", "slot")
    stream = Window.partitionBy("h1", "h2", "slot").orderBy("doc_id", "line")
    number = F.row_number().over(stream)
    return dealt.withColumn("first", (number == 1) | ~F.lag("doc_id").over(stream).eqNullSafe(F.col("doc_id")))


def drop_bitmaps(
    docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = 1, keep_first: bool = False, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Which lines go, as compressed bitmaps: doc_id, text_hash, runs (from, to: line numbers, both dropped).

    Lines whose key stands in ``least_documents`` documents or more go; with ``keep_first`` the first of all stays.
    A document is a doc_id (null is one); rows that agree in id and text share a bitmap. Documents that keep all
    lines have none.
    """
    rows = cut(occurrences(docs, least_chars, id_column, text_column))
    totals = rows.groupBy("h1", "h2").agg(
        F.sum(F.col("first").cast("long")).alias("n_documents"), F.min(F.struct("doc_id", "text_hash", "line")).alias("earliest")
    ).where(F.col("n_documents") >= least_documents).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "earliest")
    shared = rows.join(small_or_shuffled(cut(totals)), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    if keep_first:
        shared = shared.where(~F.struct("doc_id", "text_hash", "line").eqNullSafe(F.col("earliest")))
    lines = shared.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    starts = F.filter("lines", lambda x, i: (i == 0) | (F.get("lines", i - 1) != x - 1))
    ends = F.filter("lines", lambda x, i: (i == F.size("lines") - 1) | (F.get("lines", i + 1) != x + 1))
    return lines.select("doc_id", "text_hash", F.arrays_zip(starts.alias("from"), ends.alias("to")).alias("runs"))


#: Bitmaps are sent to every task only within these rows and runs (a run takes some 20 bytes); beyond, the join shuffles.
SMALL_BITMAPS, SMALL_RUNS = 200_000, 500_000


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with the lines that stay as ``text_column``; null texts become empty.

    With ``counts``, _n_lines and _n_dropped are added, in place of columns of ``docs`` with these names. Null ids and repeated
    rows are looked up like others; other columns of any name pass through; an empty table stays empty.
    """
    mark, lines = unused("mark", docs.columns), unused("lines", docs.columns)
    marks = cut(bitmaps.select(F.struct("doc_id", "text_hash", "runs").alias(mark)))
    size = marks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(f"{mark}.runs")).alias("runs")).first()
    if size["n"] <= SMALL_BITMAPS and (size["runs"] or 0) <= SMALL_RUNS:
        marks = F.broadcast(marks)
    same = docs[id_column].eqNullSafe(F.col(f"{mark}.doc_id")) & (F.xxhash64(docs[text_column].cast("string")) == F.col(f"{mark}.text_hash"))
    rows = docs.join(marks, same, "left").withColumn(lines, lines_of(text_column))
    runs = F.col(f"{mark}.runs")
    # the kept runs lie between the dropped ones
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["to"] + 1))
    ends = F.concat(F.transform(runs, lambda r: r["from"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
    dropped = F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"] + 1)
    text = F.when(runs.isNull(), F.coalesce(F.col(text_column).cast("string"), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    added = [F.size(lines).cast("long").alias("_n_lines"), F.coalesce(dropped, F.lit(0)).cast("long").alias("_n_dropped")] if counts else []
    others = [c for c in docs.columns if not counts or c not in ("_n_lines", "_n_dropped")]
    return rows.select(*[text.alias(c) if c == text_column else F.col(c) for c in others], *added)


def drop_shared_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", counts: bool = True, **options) -> DataFrame:
    """``docs`` without the lines that many documents share; columns as :func:`apply_bitmaps`."""
    return apply_bitmaps(docs, drop_bitmaps(docs, id_column=id_column, text_column=text_column, **options), id_column, text_column, counts)
