"""Exact deduplication with the state of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_KEY, id_of, materialise, new_path, remove

#: The store that keeps a stream's state on disk.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WHITE = r"[\x20\x09-\x0D]+"
#: Without it each store takes some MB ahead of what it holds.
AHEAD = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
#: The longest prefix of the digest that can be asked for, in hex digits.
DIGITS = 64
#: Batches in which the stream takes the files that it finds.
BATCHES = 2


def normalised(text: Column) -> Column:
    """Null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _locator() -> Column:
    """Where a row of a file source lies."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _rows(docs: DataFrame, id_col: str, text_col: str, digits: int) -> DataFrame:
    k = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_KEY)).alias("k")
    rows = docs.select(k, _locator().alias("locator"), normalised(F.col(f"`{text_col}`").cast("string")).alias("norm"))
    return rows.withColumn("text_sha256", F.sha2("norm", 256)).withColumn("digest", F.substring("text_sha256", 1, digits))


def digest_state(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digits: int = DIGITS, checkpoint: str | None = None, batches: int = BATCHES) -> DataFrame:
    """(digest, first_k, locator, seen): what the stream's state holds of each digest once all files under path are in.

    The state is keyed by digest, kept on disk, and never expires. Each key holds the least identifier seen, the
    content locator of that row (its file and row number) and how many rows it had. Rows are counted before they are
    shuffled, so a digest of many rows is one row from each task. The files are taken in some `batches`, so later ones
    meet the state of earlier ones. With the same `checkpoint`, a later call reads only files that are new, and goes on
    from the state there is.
    """
    found = spark.read.parquet(path)
    schema, files = found.schema, len(found.inputFiles())
    own = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, AHEAD: "false", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    base = checkpoint or new_path(spark, "stream-dedup")
    updates = f"{base}/updates"
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, a single file is a source too
        rows = stream.select(
            F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_KEY)).alias("k"),
            F.substring(F.sha2(normalised(F.col(f"`{text_col}`").cast("string")), 256), 1, digits).alias("digest"),
            _locator().alias("locator"),
        )
        state = rows.groupBy("digest").agg(F.min(F.struct("k", "locator")).alias("first"), F.count(F.lit(1)).alias("seen"))

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

        query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not checkpoint:
        remove(spark, f"{base}/state")
    kind = "digest string, first struct<k: bigint, locator: struct<file: string, row: bigint>>, seen bigint"
    told = spark.read.schema(f"{kind}, batch int").parquet(updates)
    return told.groupBy("digest").agg(F.min("first").alias("first"), F.max("seen").alias("seen")).select("digest", F.col("first.k").alias("first_k"), F.col("first.locator").alias("locator"), "seen")


def stream_exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digits: int = DIGITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): a row for each row of the Parquet table at path.

    Texts are equal if they are once null is read as empty and each run of ASCII white space as one space. The row with
    the least doc_id of equal texts stays; a null doc_id is larger than all others, and rows that share the least
    doc_id all count as kept. group_size counts rows. An empty table gives an empty one.

    The stream's state (digest_state()) gives each digest its keeper, that row's locator and the size. Every digest with
    hits is then checked over full bytes: its rows are grouped by whole text, and each group must hold the row at the
    locator. A digest with a group that does not has two texts, and its rows are told apart by text. `digits` cuts the
    digest short, to test that.
    """
    docs = spark.read.parquet(path)
    state = digest_state(spark, path, id_col, text_col, digits)
    rows = _rows(docs, id_col, text_col, digits)
    hits = state.where("seen > 1").select("digest", F.col("locator").alias("kept"))
    variants = rows.groupBy("digest", "norm").agg(F.min(F.struct("k", "locator")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    variants = variants.join(hits, "digest").select("digest", "norm", F.col("first.k").alias("keep_k"), "group_size", (F.col("first.locator") == F.col("kept")).alias("at_locator"))
    differ = variants.where(~F.col("at_locator")).select("digest").distinct()
    differ, at = materialise(differ, "collisions")
    named = rows.select("k", "digest", "text_sha256").join(state.select("digest", F.col("first_k").alias("keep_k"), F.col("seen").alias("group_size")), "digest")
    if differ.isEmpty():
        remove(spark, at)
    else:
        apart = rows.join(differ, "digest", "left_semi").join(variants.join(differ, "digest", "left_semi"), ["digest", "norm"])
        named = named.join(differ, "digest", "left_anti").select("k", "text_sha256", "keep_k", "group_size").unionAll(apart.select("k", "text_sha256", "keep_k", "group_size"))
    return named.select(id_of(F.col("k")).alias("doc_id"), id_of(F.col("keep_k")).alias("keep_id"), "group_size", (F.col("k") == F.col("keep_k")).alias("kept"), "text_sha256")
