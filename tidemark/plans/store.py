"""Queries over a table that is kept in generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.generations import Store
from ..sources.tables import new_folder, table

REGISTERED: dict = {}


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def _kept(spark: SparkSession, d: str) -> Store:
    """A table that was written in three batches, one of them twice, then changed where labels say bad, and cut where they say toxic."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    s = Store(spark, new_folder(spark, "store"))
    for batch in range(3):
        s.append(docs.where(F.col("id") % 3 == batch), "load", batch)
    s.append(docs.where("id % 3 = 1"), "load", 1)
    s.append(docs.join(labels.where("quality = 0").select("id").distinct(), "id", "left_semi").withColumn("text", F.lit("stale")), "edit", 0)
    s.delete(labels.where("toxic = 1"), "edit", 1)
    return s


_LABELLED = "l AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id), d AS (SELECT documents.doc_id AS id, coalesce(text, '') AS text, coalesce(quality, 1) = 0 AND coalesce(text, '') <> 'stale' AS stale, coalesce(toxic, 0) = 1 AS gone FROM documents LEFT JOIN l ON l.doc_id = documents.doc_id)"


@query(f"WITH {_LABELLED} SELECT id, CAST(CASE WHEN stale THEN 4 ELSE id % 3 + 1 END AS INTEGER) AS generation, md5(CASE WHEN stale THEN 'stale' ELSE text END) AS content FROM d WHERE NOT gone")
def store_generations(spark: SparkSession, d: str) -> DataFrame:
    """What a reader sees of the newest generation: each record with the generation that wrote it."""
    return _kept(spark, d).read().select("id", "generation", F.md5("text").alias("content"))


@query(f"WITH {_LABELLED} SELECT id, CASE WHEN gone THEN 'gone' ELSE 'changed' END AS change FROM d WHERE gone OR stale")
def store_difference(spark: SparkSession, d: str) -> DataFrame:
    """What was done to the table since all was loaded, from the buckets whose fingerprints differ."""
    s = _kept(spark, d)
    return s.difference(3, s.manifest()["generation"])
