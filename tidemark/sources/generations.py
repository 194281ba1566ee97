"""A table of records in generations: writes that can be replayed, readers that see one generation, differences by fingerprints of buckets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new table by a hash of the id; each has a fingerprint, and is what a difference reads.
BUCKETS = 64
_OWN = "_hash", "_gone", "_generation", "_bucket"


class Conflict(RuntimeError):
    """Another writer has published the generation first; the batch can be written again."""


class Store:
    """A folder that driver and executors share, in which only what a manifest names is part of the table.

    A manifest is a small file for each generation: the folders of its rows, the folder of its fingerprints, and the last
    batch of each writer. It appears under its number by one rename that never replaces, after all it names is
    written. So a job that is killed leaves the last generation as it was, a batch that is replayed changes nothing, and two
    writers cannot both publish a number. Rows are keyed by id and a hash of the rest; equal ones are not written again.
    The newest version of an id holds, and a deleted id is a version too.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str = "id", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.id, self.buckets = spark, path.rstrip("/"), id_col, buckets

    # manifests

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def _published(self) -> list[int]:
        at, fs = self._fs(f"{self.path}/manifest")
        if not fs.exists(at):
            return []
        return sorted(int(n) for s in fs.listStatus(at) if (n := s.getPath().getName()).isdecimal())

    def manifest(self, generation: int | None = None) -> dict:
        """What a generation is made of, the newest unless one is named; an empty one before the first."""
        if generation is None:
            generation = max(self._published(), default=0)
        if generation == 0:
            return {"generation": 0, "writers": {}, "parts": [], "prints": None, "buckets": self.buckets}
        at, fs = self._fs(f"{self.path}/manifest/{generation:012d}")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))  # noqa: SLF001
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        jvm = self.spark._jvm  # noqa: SLF001
        draft, fs = self._fs(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        final, _ = self._fs(f"{self.path}/manifest/{manifest['generation']:012d}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True), "utf-8"))
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        plain = self.spark.sparkContext._gateway.new_array(kind, 1)  # noqa: SLF001
        plain[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, plain)  # noqa: SLF001
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"generation {manifest['generation']} is there already") from e
            raise

    # reading

    def _bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(self.id), F.lit(manifest["buckets"])).cast("int")

    def _versions(self, manifest: dict, only: list[int] | None = None) -> DataFrame | None:
        if not manifest["parts"]:
            return None
        paths = [f"{self.path}/{p}" for p in manifest["parts"]]
        rows = self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", "true").parquet(*paths)
        rows = rows.drop("_part")
        if only is not None:
            rows = rows.where(F.col("_bucket").isin(only))
        if len(paths) == 1:
            return rows
        rest = [c for c in rows.columns if c != self.id]
        newest = rows.groupBy(self.id).agg(F.max_by(F.struct(*rest), "_generation").alias("v"))
        return newest.select(self.id, *(F.col(f"v.`{c}`").alias(c) for c in rest))

    def read(self, generation: int | None = None, links: str | None = None) -> DataFrame:
        """The rows of one generation, the newest unless one is named. With `links`, that array of ids is left with those that are there."""
        rows = self._versions(self.manifest(generation))
        if rows is None:
            raise LookupError(f"{self.path} has no generation")
        live = rows.where(~F.col("_gone"))
        shown = live.withColumnRenamed("_generation", "generation").drop("_hash", "_gone", "_bucket")
        if links is None:
            return shown
        each = shown.select(self.id, F.posexplode(links).alias("at", "to"))
        there = each.join(live.select(F.col(self.id).alias("to")), "to", "left_semi")
        kept = there.groupBy(self.id).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "to"))), lambda x: x["to"]).alias("kept"))
        order = shown.columns
        joined = shown.join(kept, self.id, "left").withColumn(links, F.coalesce("kept", F.slice(links, 1, 0)))
        return joined.select(*order)

    # writing

    def append(self, rows: DataFrame, writer: str, batch: int) -> int:
        """Write the rows that are new or differ from what is there; of rows that share an id, the one of the greatest hash. The generation after it.

        A batch that the writer has written before, or an earlier one, changes nothing.
        """
        return self._write(rows.withColumn("_gone", F.lit(False)), writer, batch)

    def delete(self, ids: DataFrame, writer: str, batch: int) -> int:
        """Write that ids (id) are gone; those that are not there are left out."""
        return self._write(ids.select(self.id).distinct().withColumn("_gone", F.lit(True)), writer, batch)

    def sink(self, writer: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch() of a stream, which replays a batch under its number."""

        def write(rows: DataFrame, batch: int) -> None:
            self.append(rows, writer, batch)

        return write

    def _write(self, rows: DataFrame, writer: str, batch: int) -> int:
        m = self.manifest()
        if batch <= m["writers"].get(writer, -1):
            return m["generation"]
        hashed = self._hashed(rows)
        before = self._versions(m)
        old = hashed.select(self.id, F.lit(None).cast("string").alias("_old"), F.lit(True).alias("_absent")).limit(0) if before is None else before.select(self.id, F.col("_hash").alias("_old"), F.col("_gone").alias("_absent"))
        met = hashed.join(old, self.id, "left")
        new = met.where(F.when(F.col("_gone"), ~F.coalesce("_absent", F.lit(True))).otherwise(F.coalesce("_absent", F.lit(True)) | (F.col("_old") != F.col("_hash"))))
        n = m["generation"] + 1
        part = f"data/_part=g{n}-{uuid.uuid4().hex}"
        put = new.select("*", F.lit(n).alias("_generation"), self._bucket(m).alias("_bucket"))
        put.drop("_absent").repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{part}")
        done = self.spark.read.parquet(f"{self.path}/{part}")
        value = lambda c: F.xxhash64(self.id, c).cast("decimal(38,0)")
        was = F.col("_old").isNotNull()
        delta = done.groupBy(F.col("_bucket").cast("int").alias("bucket")).agg(
            F.sum(F.when(F.col("_gone"), -1).otherwise(F.when(was, 0).otherwise(1))).alias("n"),
            (F.coalesce(F.sum(F.when(~F.col("_gone"), value("_hash"))), F.lit(0)) - F.coalesce(F.sum(F.when(was, value("_old"))), F.lit(0))).cast("decimal(38,0)").alias("total"),
        )
        return self._close(m, n, [*m["parts"], part], delta, writer, batch)

    def _hashed(self, rows: DataFrame) -> DataFrame:
        """One row for each id, with a hash of all its columns; a deleted row has none."""
        rest = sorted(c for c in rows.columns if c not in (self.id, *_OWN))
        named = rows.where(F.col(self.id).isNotNull()).withColumn("_hash", F.when(~F.col("_gone"), F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rest)), {"ignoreNullFields": "false"}), 256)) if rest else F.lit(None).cast("string"))
        columns = [c for c in named.columns if c != self.id]
        one = named.groupBy(self.id).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in columns)), F.coalesce("_hash", F.lit(""))).alias("v"))
        return one.select(self.id, *(F.col(f"v.`{c}`").alias(c) for c in columns))

    def _close(self, m: dict, n: int, parts: list[str], delta: DataFrame, writer: str, batch: int) -> int:
        prints = f"prints/g{n}-{uuid.uuid4().hex}"
        if m["prints"] and len(parts) > 1:
            delta = delta.unionByName(self.spark.read.parquet(f"{self.path}/{m['prints']}"))
        summed = delta.groupBy("bucket").agg(F.sum("n").cast("long").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
        summed.where("n <> 0 or total <> 0").coalesce(1).write.parquet(f"{self.path}/{prints}")
        self._publish(m | {"generation": n, "parts": parts, "prints": prints, "writers": m["writers"] | {writer: batch}})
        return n

    def rebuild(self, rows: DataFrame, writer: str, batch: int, counts: tuple[str, ...] = (), latest: tuple[str, ...] = ()) -> int:
        """Replace all rows by these in one step; of an id that was there before, columns in `counts` are added up and of those in `latest` the later holds.

        Readers see the old generation until the new one is whole. It has one folder, so reading it needs no comparison of versions.
        """
        m = self.manifest()
        if batch <= m["writers"].get(writer, -1):
            return m["generation"]
        before = self._versions(m)
        if before is not None and (counts or latest):
            old = before.where(~F.col("_gone")).select(self.id, *(F.col(c).alias(f"_old_{c}") for c in (*counts, *latest)))
            order = rows.columns
            rows = rows.join(old, self.id, "left")
            for c in counts:
                rows = rows.withColumn(c, F.coalesce(c, F.lit(0)) + F.coalesce(f"_old_{c}", F.lit(0)))
            for c in latest:
                rows = rows.withColumn(c, F.greatest(c, f"_old_{c}"))
            rows = rows.select(*order)
        n = m["generation"] + 1
        part = f"data/_part=g{n}-{uuid.uuid4().hex}"
        put = self._hashed(rows.withColumn("_gone", F.lit(False))).select("*", F.lit(n).alias("_generation"), self._bucket(m).alias("_bucket"), F.lit(None).cast("string").alias("_old"))
        put.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{part}")
        done = self.spark.read.parquet(f"{self.path}/{part}")
        prints = done.groupBy(F.col("_bucket").cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(self.id, "_hash").cast("decimal(38,0)")).cast("decimal(38,0)").alias("total"))
        return self._close(m, n, [part], prints, writer, batch)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove folders that none of the last `keep` generations names, and older manifests; what was removed. No writer may be at work."""
        numbers = self._published()
        kept = [self.manifest(n) for n in numbers[-keep:]]
        named = {p for m in kept for p in (*m["parts"], m["prints"])}
        gone = []
        for top in ("data", "prints"):
            at, fs = self._fs(f"{self.path}/{top}")
            gone += [f"{top}/{s.getPath().getName()}" for s in (fs.listStatus(at) if fs.exists(at) else [])]
        gone = [p for p in gone if p not in named] + [f"manifest/{n:012d}" for n in numbers[:-keep]]
        for p in gone:
            at, fs = self._fs(f"{self.path}/{p}")
            fs.delete(at, True)
        return gone

    # differences

    def changed_buckets(self, old: int, new: int) -> list[int]:
        """Buckets whose fingerprints differ; a manifest bounds their number."""
        each = [self.spark.read.parquet(f"{self.path}/{p}") if (p := self.manifest(g)["prints"]) else None for g in (old, new)]
        if each[0] is None or each[1] is None:
            return list(range(self.manifest(max(old, new))["buckets"]))
        a, b = each[0].toDF("bucket", "n", "total"), each[1].toDF("bucket", "m", "sum")
        met = a.join(b, "bucket", "full").where(~(F.col("n").eqNullSafe(F.col("m")) & F.col("total").eqNullSafe(F.col("sum"))))
        return sorted(r["bucket"] for r in met.select("bucket").collect())

    def difference(self, old: int, new: int) -> DataFrame:
        """(id, change) from one generation to another: added, changed or gone. Only buckets whose fingerprints differ are read."""
        only = self.changed_buckets(old, new)

        def rows(generation: int, name: str) -> DataFrame:
            found = self._versions(self.manifest(generation), only)
            if found is None:
                found = self._versions(self.manifest(max(old, new)), []).where(F.lit(False))
            return found.where(~F.col("_gone")).select(self.id, F.col("_hash").alias(name))

        met = rows(old, "_a").join(rows(new, "_b"), self.id, "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
        change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "gone").otherwise("changed")
        return met.select(self.id, change.alias("change"))
