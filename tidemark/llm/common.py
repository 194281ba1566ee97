"""What the corpus operators share: inputs, shared storage, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null identifier while rows are joined; it sorts after every other.
NULL_KEY = 2**63 - 1
#: Temporary folders that this process has made on a local master, by application.
_MADE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns (k, text): the identifier with nulls as NULL_KEY, and the text with nulls as ''.

    Other columns are left behind, so their names cannot clash with those an operator adds. An identifier must be a
    whole number below NULL_KEY: in ANSI mode, Spark's default, one that cannot be read as a long ends the job with an
    error (otherwise it counts as null), and NULL_KEY itself counts as null.
    """
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_KEY)).alias("k"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def id_of(key: Column) -> Column:
    """The identifier of a key made by keyed()."""
    return F.when(key != F.lit(NULL_KEY), key)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns (k, t, text): keyed() with a hash of the text, so rows that share an identifier are told apart by their texts."""
    return keyed(docs, id_col, text_col).select("k", F.xxhash64("text").alias("t"), "text")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master, which has no other machines, gets a temporary one where that is unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        _MADE[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _MADE[app]


def scratch(spark: SparkSession) -> str:
    """The folder of this application in the shared one; nothing in it is needed once the application has ended."""
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Remove all that the operators of this application have written to the shared folder; results must have been read."""
    remove(spark, scratch(spark))


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: later reads survive the loss of any executor."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)  # noqa: SLF001


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """While it is open, Spark removes the shuffle files of each statement as it ends, for steps whose results are written tables.

    Otherwise they stay until the driver happens to collect its plans. A lost executor costs a running statement a
    stage, as ever; ended ones are not asked again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """(node, component): the least node reachable, for each node of an undirected graph of long nodes.

    After a number of rounds, where one is given, component is the least node that has been found so far: one that is
    reachable, but not always the least.

    Alternates large-star and small-star contraction until the edges stay as they are. Every round is two joins on the
    node and is written to the shared folder, so neither lineage nor driver memory grows with the graph. A hub's rows
    are joined, never collected, so a skewed join can be split. Rounds go on until nothing changes; their number grows
    with the logarithm of the longest chain. Nulls and self-loops are ignored.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    e = e.where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, path = materialise(e, "edges")
    before, done = None, 0
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        nxt, nxt_path = materialise(small.where("u <> v").distinct(), "edges")
        remove(spark, path)
        e, path, done = nxt, nxt_path, done + 1
        if done == rounds:
            e = e.groupBy("u").agg(F.min("v").alias("v"))
            break
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct()
    if rounds is not None:  # a node that others point to may itself point on
        roots = roots.join(e.select(F.col("u").alias("node")), "node", "left_anti")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
