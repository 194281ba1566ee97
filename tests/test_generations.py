"""Generations: replays, kills, restarts, rebuilds, deletions and differences."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources.generations import Conflict, Store

ROW = "id long, text string, uses long, related array<long>"


def rows(spark, *each):
    return spark.createDataFrame([(i, t, u, list(r)) for i, t, u, r in each], ROW)


def held(store, **more):
    return {r["id"]: (r["text"], r["generation"]) for r in store.read(**more).collect()}


def test_replayed_and_killed_batches_change_nothing(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "t"), buckets=8)
    with pytest.raises(LookupError):
        s.read()
    first = rows(spark, (1, "a", 0, []), (2, "b", 0, []), (2, "b", 0, []), (None, "n", 0, []))
    assert s.append(first, "w", 0) == 1 and s.append(first, "w", 0) == 1
    assert held(s) == {1: ("a", 1), 2: ("b", 1)}
    second = rows(spark, (2, "c", 0, []), (1, "a", 0, []), (3, "d", 0, []))
    publish = s._publish
    monkeypatch.setattr(s, "_publish", lambda m: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        s.append(second, "w", 1)
    assert held(s) == {1: ("a", 1), 2: ("b", 1)}
    monkeypatch.setattr(s, "_publish", publish)
    assert s.append(second, "w", 1) == 2 == s.append(second, "w", 1) == s.append(first, "w", 0)
    assert held(s) == {1: ("a", 1), 2: ("c", 2), 3: ("d", 2)} and held(s, generation=1) == {1: ("a", 1), 2: ("b", 1)}
    assert s.append(first, "other", 0) == 3 and held(s)[2] == ("b", 3)  # an earlier content may come back
    assert len(s.vacuum(keep=1)) > 0 and held(s)[2] == ("b", 3)


def test_two_writers_cannot_publish_one_number(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    s.append(rows(spark, (1, "a", 0, [])), "w", 0)
    with pytest.raises(Conflict):
        s._publish(s.manifest(1))
    assert held(s) == {1: ("a", 1)}


def test_deleted_rows_and_links_to_them_go(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    s.append(rows(spark, (1, "a", 0, [3, 2, 9]), (2, "b", 0, [1]), (3, "c", 0, [])), "w", 0)
    assert s.delete(spark.createDataFrame([(2,), (7,)], "id long"), "w", 1) == 2
    assert {r["id"]: r["related"] for r in s.read(links="related").collect()} == {1: [3], 3: []}
    s.append(rows(spark, (2, "b", 0, [1])), "w", 2)
    assert {r["id"]: r["related"] for r in s.read(links="related").collect()} == {1: [3, 2], 2: [1], 3: []}


def test_a_rebuild_keeps_usage_and_is_one_step(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    s.append(rows(spark, (1, "a", 5, []), (2, "b", 1, [])), "w", 0)
    s.append(rows(spark, (1, "a", 6, []), (4, "x", 1, [])), "w", 1)
    assert s.rebuild(rows(spark, (1, "A", 2, []), (3, "c", 1, [])), "w", 2, counts=("uses",)) == 3
    assert {r["id"]: (r["text"], r["uses"]) for r in s.read().collect()} == {1: ("A", 8), 3: ("c", 1)} and len(s.manifest()["parts"]) == 1
    assert {r["id"]: r["change"] for r in s.difference(2, 3).collect()} == {1: "changed", 2: "gone", 4: "gone", 3: "added"}


def test_differences_read_only_what_differs(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"), buckets=32)
    base = spark.range(2000).select("id", F.concat(F.lit("t"), "id").alias("text"), F.lit(0).cast("long").alias("uses"), F.array().cast("array<long>").alias("related"))
    s.append(base, "w", 0)
    assert s.changed_buckets(1, 1) == []
    s.append(rows(spark, (7, "new", 0, []), (5000, "more", 0, [])), "w", 1)
    s.delete(spark.createDataFrame([(9,)], "id long"), "w", 2)
    assert {r["id"]: r["change"] for r in s.difference(1, 3).collect()} == {7: "changed", 5000: "added", 9: "gone"}
    assert {r["id"]: r["change"] for r in s.difference(3, 1).collect()} == {7: "changed", 5000: "gone", 9: "added"}
    buckets = s.changed_buckets(1, 3)
    assert 1 <= len(buckets) <= 3 and s._versions(s.manifest(1), buckets).count() < 2000 * 5 / 32
    plan = s.difference(1, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan
    s.append(rows(spark, (7, "t7", 0, [])), "w", 3)
    s.delete(spark.createDataFrame([(5000,)], "id long"), "w", 4)
    s.append(base.where("id = 9"), "w", 5)
    assert s.changed_buckets(1, 6) == [] and s.difference(1, 6).count() == 0
    assert {r["change"] for r in s.difference(0, 1).collect()} == {"added"} and s.difference(0, 1).count() == 2000


def test_a_stream_may_replay_its_batch(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    rows(spark, *((i, f"t{i}", 0, []) for i in range(20))).write.parquet(str(tmp_path / "in"))
    stream = lambda ck: spark.readStream.schema(ROW).parquet(str(tmp_path / "in")).writeStream.foreachBatch(s.sink("stream")).option("checkpointLocation", str(tmp_path / ck)).trigger(availableNow=True).start().awaitTermination()
    stream("a")
    stream("b")  # the checkpoint was lost: batch 0 comes again
    assert s.manifest()["generation"] == 1 and len(held(s)) == 20
