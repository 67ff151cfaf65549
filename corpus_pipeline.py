"""A corpus pipeline of five stages over ``documents``: each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from cleanloom.llm.common import shared_folder, table
from cleanloom.llm.queries import vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go.

    Null and empty texts stay; rows that repeat are judged alike; without labels of both classes, or without documents,
    nothing goes. Columns of any name pass through.
    """
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, lexicon)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; all documents stay, and n_chars follows the text.

    Null texts become empty ones; rows of one id count as one document; an empty table stays empty.
    """
    kept = line_dedup.drop_shared_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near sets of shingles the one with the smallest id stays.

    Texts without words stay; rows that share the smallest id all stay; null ids count as largest; an empty table stays empty.
    """
    return ngram_join.one_of_each(docs).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    Null texts have no words and follow their source; a null source is a source; equal rows are taken alike; an
    empty table stays empty.
    """
    return mixing.mix(docs).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is an empty one; null ids and repeated rows come back as they are; an empty table gives an empty one.
    """
    return bpe.round_trip(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_shared_lines),
    ("n-gram Jaccard join", one_of_near),
    ("mixing", mixed),
    ("BPE", encoded),
]

#: The first stage learns its lexicon, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "corpus")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
