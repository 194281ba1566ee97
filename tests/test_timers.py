"""Timers and cooldowns over files that come one run after another, each run a restart."""

from datetime import datetime, timedelta

import pytest

from tidemark.streaming import timers

START = datetime(2024, 1, 1)
COMMAND = "id long, at timestamp, event string, due_at timestamp, step_s long, most int"


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


class Job:
    def __init__(self, spark, tmp, schema, make):
        self.spark, self.tmp, self.schema, self.make, self.runs = spark, tmp, schema, make, 0

    def run(self, rows):
        """Add one file, and run what is there to its end; what came out in this run."""
        self.runs += 1
        (self.tmp / "in").mkdir(exist_ok=True)
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.tmp / "in"))
        stream = self.make(self.spark.readStream.schema(self.schema).parquet(str(self.tmp / "in")))
        out = str(self.tmp / f"out{self.runs}")
        keep = lambda df, _: df.write.mode("append").parquet(out)
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(self.tmp / "ck")).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, self.spark.read.parquet(out).collect()))


def hour(n):
    return START + timedelta(hours=n)


def test_a_timer_fires_once_after_downtime_and_after_a_restart(rocks, tmp_path):
    job = Job(rocks, tmp_path, COMMAND, timers.repeating)
    tick = lambda n: (99, hour(n), "tick", None, None, None)
    sets = [(1, hour(0), "set", hour(1), 3600, None), (2, hour(0), "set", hour(1), 3600, 2), (3, hour(0), "set", hour(2), 0, None), (4, hour(0), "set", hour(1), 3600, None), (5, hour(0), "set", hour(90), 60, None)]
    assert job.run(sets) == []
    first = job.run([tick(1.5), (4, hour(1), "cancel", None, None, None)])
    assert [(x[0], x[1], x[3], x[4], x[5]) for x in first] == [(1, hour(1), 1, 0, False), (2, hour(1), 1, 0, False)]
    later = job.run([tick(30.5)])  # 29 slots have passed
    assert [(x[0], x[1], x[3], x[4], x[5]) for x in later] == [(1, hour(2), 2, 28, False), (2, hour(2), 2, 28, True), (3, hour(2), 1, 0, True)]
    assert [(x[0], x[1], x[3], x[4]) for x in job.run([tick(31.5), (5, hour(31), "set", hour(91), 60, None)])] == [(1, hour(31), 3, 0)]
    assert [x[:2] for x in job.run([(1, hour(31.6), "cancel", None, None, None), tick(90.9)])] == []  # 5 was moved to hour 91


def test_cooldowns_hold_over_restarts(rocks, tmp_path):
    job = Job(rocks, tmp_path, "id long, at timestamp", lambda s: timers.cooled(s, 3600, delay="10 minutes"))
    assert job.run([(1, hour(0)), (1, hour(0.5)), (1, hour(1)), (2, hour(0.2))]) == [(1, hour(0), 1), (1, hour(1), 2), (2, hour(0.2), 1)]
    assert job.run([(1, hour(1.5)), (2, hour(1.3))]) == [(2, hour(1.3), 2)]
    assert job.run([(3, hour(9))]) == [(3, hour(9), 1)]
    assert job.run([(1, hour(10)), (2, hour(10))]) == [(1, hour(10), 1), (2, hour(10), 1)]


def test_bounds_hold_for_good(rocks, tmp_path):
    job = Job(rocks, tmp_path, "id long, at timestamp", lambda s: timers.cooled(s, 60, most=2))
    assert len(job.run([(1, hour(n)) for n in range(5)])) == 2
    assert job.run([(1, hour(50)), (2, hour(50))]) == [(2, hour(50), 1)]


def test_slots():
    assert timers.next_slot(10, 5, 3) == (15, 0) and timers.next_slot(10, 5, 15) == (20, 1) and timers.next_slot(10, 5, 14) == (15, 0) and timers.next_slot(10, 5, 110) == (115, 20)
