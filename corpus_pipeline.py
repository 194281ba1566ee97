"""The corpus pipeline: quality, repeated lines, near-duplicates, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, near_copies, packing, pii, quality
from tidemark.llm.common import new_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """A row for each of (doc_id, text), with the language and source of its doc_id and its own length.

    Repeated rows stay as many; of rows that share a doc_id, the least language and source are taken.
    """
    rest = docs.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("source").alias("source"))
    new = texts.select(F.col("doc_id").alias("id"), "text", F.char_length("text").cast("long").alias("n_chars"))
    return new.join(rest, F.col("doc_id").eqNullSafe(F.col("id"))).select(COLUMNS)


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose doc_id is in kept; a null one is like any other."""
    ids = kept.select(F.col("doc_id").alias("id")).distinct()
    return docs.select(COLUMNS).join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts good."""
    scores = quality.quality_scores(docs, table(spark, sf_dir, "labels"))
    return _only(docs, scores.where("predicted = 1"))


def no_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of passages that occur earlier."""
    return _with_text(docs, line_dedup.line_dedup(docs).select("doc_id", "text"))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of least doc_id: SimHash over five-word shingles, completed to all pairs of Jaccard 0.8."""
    return near_copies.first_copies(docs.select(COLUMNS))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data."""
    return _with_text(docs, pii.pii_pseudonyms(docs, pii.key_of(spark)).select("doc_id", "text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("line dedup", no_repeated_lines),
    ("SimHash near-dedup", no_near_duplicates),
    ("PII", no_personal_data),
    ("best-fit packing", packed),
]
#: The stages learn, hash and pack in ways that SQL has no words for; the tests hold them against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
