"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, SentencePiece.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of documents. SQL
cannot express the hashed weights, the draws and the Viterbi paths, so ORACLE_SQL is None and the
stages are tested against brute force.

Defined cases, by stage: null and empty texts fail the quality rules and go; very long texts are
judged, compared, mixed and encoded whole; repeated rows are copies, of which one stays; ties are
settled as each operator says; null ids and null sources are rows like any other; an empty table
passes all stages as an empty table, with its columns; further columns, whatever their names, are
handed on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomrec.llm import exact_dedup, mixing, near_dedup, quality, sentencepiece_codec
from loomrec.session import write_through


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, those of a similarity of 0.80 or more."""
    return near_dedup.drop_near(docs, similarity=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for each epoch that takes of it, with the words taken."""
    return mixing.mix_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, decoded and compared."""
    return sentencepiece_codec.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", sentencepiece),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = ()
    for name, stage in STAGES[:-1]:
        docs = write_through(stage(spark, docs, sf_dir), f"pipeline-{name}", drop=written)
        written = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
