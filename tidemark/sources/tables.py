"""Readers of the tables, and the record model derived from them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder: that of spark.checkpoint.dir. Only a local master, which has no other machines, gets a temporary one where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = sc.getConf().get("spark.checkpoint.dir", None)
        if not found and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder: later steps read it from there, on whatever executor."""
    _shared(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the checkpoint folder that nothing has used."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the checkpoint folder, for rounds of a loop.

    A checkpoint keeps the size that its plan was guessed to have, which joins multiply; after some rounds the guesses are
    numbers of a million digits. A table has the size of its files.
    """
    path = new_folder(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an agent's memory, one for each document; every derived column is a function of doc_id."""
    i = F.col("doc_id")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(i, F.lit(n)) + 1).cast("int"))
    created = F.timestamp_seconds(F.lit(1704067200) + i * 3600)
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("title"), F.coalesce("text", F.lit("")).alias("content"), F.col("source"),
        F.array(F.col("lang"), F.col("source")).alias("tags"), pick(3, "short-term", "mid-term", "long-term").alias("layer"),
        pick(5, "@public", "@community", "@work-circle", "@inner-circle", "@chef-only").alias("context_tag"), pick(4, "user", "tool", "web", "self-generated").alias("tier"),
        created.alias("created_at"), F.when(i % 5 == 0, created + F.expr("interval 30 days")).alias("valid_to"),
        F.when(i % 4 == 1, i - 1).alias("parent_id"), F.when((i % 10 == 0) & (i >= 10), i - 10).alias("supersedes_id"),
        (F.pmod(i * 7, F.lit(101)) / 10.0).alias("intensity"), F.pmod(i, F.lit(7)).alias("access_count"),
    )


#: The same in DuckDB's SQL, as a common table expression.
MEMORIES_SQL = """mem AS (SELECT doc_id AS id, substring(coalesce(text, ''), 1, 60) AS title, coalesce(text, '') AS content, source, [lang, source] AS tags,
  ['short-term', 'mid-term', 'long-term'][doc_id % 3 + 1] AS layer,
  ['@public', '@community', '@work-circle', '@inner-circle', '@chef-only'][doc_id % 5 + 1] AS context_tag,
  ['user', 'tool', 'web', 'self-generated'][doc_id % 4 + 1] AS tier,
  TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS created_at,
  CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) + INTERVAL 30 DAY END AS valid_to,
  CASE WHEN doc_id % 4 = 1 THEN doc_id - 1 END AS parent_id, CASE WHEN doc_id % 10 = 0 AND doc_id >= 10 THEN doc_id - 10 END AS supersedes_id,
  (doc_id * 7 % 101) / 10.0 AS intensity, doc_id % 7 AS access_count FROM documents)"""


#: Sentences about a part, one kind for each remainder of its key; {} stands for its name.
NOTES = [
    "We decided to order the {} today. The {} must be shipped by Friday, therefore the contract applies.",
    "I prefer the {} over the old one. Please never use the plain {} again.",
    "The {} was broken last week. The root cause turned out to be a crack, see 15 U.S.C. 2301 and Section 402A.",
    "All tests pass for the {} since yesterday. We shipped it at last.",
    "# Care of the {}\nKeep it dry.\n## Storage\nThe {} shall not be stored outside.",
    "Thank you for the {}! I love it, this matters to me.",
    "How do I clean the {}? Do it next Monday or on Tuesday.",
    "The {} is not available any more. It was replaced by a better one on Friday.",
    "Alice Baker and Bob Carter looked at the {} two days ago, as UCC 2-314 requires.",
    "Remind me of the {} in 3 hours. Data of the release is due tomorrow.",
    "The {} works. It shows that a good design lasts.",
    "Tonight we will test the {} and merge the change. Don't touch it, stop using it this week.",
]


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short note about each part: (id, name, text, day); its text and day are functions of the part."""
    i = F.col("p_partkey")
    text = F.replace(F.element_at(F.array(*map(F.lit, NOTES)), (F.pmod(i, F.lit(len(NOTES))) + 1).cast("int")), F.lit("{}"), F.col("p_name"))
    return table(spark, sf_dir, "part").select(i.alias("id"), F.col("p_name").alias("name"), text.alias("text"), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(i, F.lit(400)).cast("int")).alias("day"))


#: The same in DuckDB's SQL.
NOTES_SQL = "note AS (SELECT p_partkey AS id, p_name AS name, replace([" + ", ".join("'" + n.replace("'", "''") + "'" for n in NOTES) + f"][p_partkey % {len(NOTES)} + 1], '{{}}', p_name) AS text, DATE '2024-01-01' + CAST(p_partkey % 400 AS INTEGER) AS day FROM part)"
