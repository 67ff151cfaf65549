"""Reading and writing the file layouts of the domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.functions.columns import nan_to_null

# fixed values: the canonical columns of a price series
PRICE_COLUMNS = ["Date", "Open", "High", "Low", "Close", "Adj Close", "Volume"]

PRICE_SCHEMA = T.StructType(
    [T.StructField("Date", T.DateType())] + [T.StructField(c, T.DoubleType()) for c in PRICE_COLUMNS[1:]]
)
RESULT_SCHEMA = "best_epoch BIGINT, best_val_loss DOUBLE, best_tr_loss DOUBLE, best_test_loss DOUBLE"
CHOICE_SCHEMA = "num_tf ARRAY<STRING>, cat_tf ARRAY<STRING>, normalization ARRAY<STRING>"


def read_series(spark: SparkSession, path: str, schema: T.StructType = PRICE_SCHEMA) -> DataFrame:
    """S1. All per-symbol CSV files of a folder; ``symbol`` is the file name up to the first ``_`` or ``.``."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    symbol = F.regexp_extract(F.col("_metadata.file_name"), "^([^_.]+)", 1)
    return nan_to_null(rows.select("*", F.url_decode(symbol).alias("symbol")))


def write_partitions(df: DataFrame, path: str, keys: Sequence[str] = ("symbol", "partition_id"), fmt: str = "parquet") -> None:
    """S2. One folder per series and partition.

    Rows are not gathered per folder: a task may write to several folders, so a hot series is written by many tasks.
    """
    writer = df.write.mode("overwrite").partitionBy(*keys)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def scores_to_wide(scores: DataFrame, keys: Sequence[str], methods: Sequence[str], value: str = "rmse") -> DataFrame:
    """S3. The wide form of a score table: one column per method, in the given order."""
    return scores.groupBy(*keys, "model").pivot("method", list(methods)).agg(F.first(value))


def write_scores(scores: DataFrame, path: str, keys: Sequence[str], methods: Sequence[str], value: str = "rmse") -> None:
    """S3. Wide score table as CSV. A colon cannot be part of a file name everywhere, so it becomes ``_``."""
    scheme, sep, rest = path.rpartition("://")
    scores_to_wide(scores, keys, methods, value).write.mode("overwrite").option("header", True).csv(
        scheme + sep + rest.replace(":", "_")
    )


def read_scores(spark: SparkSession, path: str, methods: Sequence[str], keys: str = "symbol STRING, partition_id BIGINT") -> DataFrame:
    """S3. Wide score CSV back to long form: keys, model, method, rmse."""
    schema = T.StructType.fromDDL(keys)
    key_names = schema.fieldNames()
    schema = schema.add("model", "string")
    for m in methods:
        schema = schema.add(m, "double")
    wide = spark.read.schema(schema).option("header", True).csv(path)
    return wide.unpivot([*key_names, "model"], list(methods), "method", "rmse")


def _run_id(levels: int = 1) -> Column:
    """The folder that holds the file, ``levels`` up."""
    return F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)" + "/[^/]+" * levels + "$", 1)


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """S4. ``result.json`` files of many run folders; ``run`` is the folder name."""
    rows = spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(pattern)
    return rows.select(_run_id().alias("run"), _run_id(3).alias("collection"), "*")


def read_choices(spark: SparkSession, pattern: str) -> DataFrame:
    """S4. The option names each run chose per feature."""
    rows = spark.read.schema(CHOICE_SCHEMA).option("multiLine", True).json(pattern)
    return rows.select(_run_id().alias("run"), "*")


def write_runs(runs: DataFrame, path: str, run: str = "run") -> None:
    """S4. Results, parameters or choices as JSON, one folder per run."""
    runs.write.mode("overwrite").partitionBy(run).json(path)


def read_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """S5. A dataset folder with ``data.csv`` and ``info.json``; returns the table and the name of the label column.

    Listed columns are dropped, listed categories become text, and the text 'nan' is a missing category.
    """
    info = (
        spark.read.schema("label STRING, drop_variables ARRAY<STRING>, categorical_variables ARRAY<STRING>")
        .option("multiLine", True)
        .json(f"{folder}/info.json")
        .first()
    )
    data = spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/data.csv")
    data = nan_to_null(data.drop(*(info["drop_variables"] or [])))
    text = {c: F.nullif(F.col(c).cast("string"), F.lit("nan")) for c in info["categorical_variables"] or []}
    return data.withColumns(text), info["label"]


def read_listing(spark: SparkSession, path: str, column: str = "Symbol") -> DataFrame:
    """S8. Symbols of a pipe-separated listing that consist of letters only."""
    rows = spark.read.option("header", True).option("sep", "|").csv(path)
    return letters_only(rows, column).select(column)


def letters_only(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is not missing, is no number and has letters only."""
    c = F.col(column)
    return df.where(c.isNotNull() & c.try_cast("double").isNull() & c.rlike(r"^\p{L}+$"))


def canonical_prices(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """S9. Pick the source columns ``names`` and give them the canonical names; rows without any price are dropped."""
    out = df.select([F.col(f"`{n}`").alias(c) for n, c in zip(names, PRICE_COLUMNS, strict=True)])
    return out.dropna(how="all", subset=PRICE_COLUMNS[1:])
