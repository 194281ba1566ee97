"""Streaming jobs: event logs without repeats, timers, uses, and intentions as state machines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What an event makes of an intention in a state; ended ones stay as they are. Fixed values.
TRANSITIONS = {
    ("pending", "arm"): "armed", ("pending", "fire"): "fired", ("pending", "done"): "done", ("pending", "snooze"): "pending", ("pending", "cancel"): "cancelled", ("pending", "expire"): "expired", ("pending", "invalidate"): "invalidated",
    ("armed", "fire"): "fired", ("armed", "snooze"): "armed", ("armed", "done"): "done", ("armed", "cancel"): "cancelled", ("armed", "expire"): "expired", ("armed", "invalidate"): "invalidated",
    ("fired", "fire"): "fired", ("fired", "snooze"): "armed", ("fired", "done"): "done", ("fired", "cancel"): "cancelled", ("fired", "expire"): "expired", ("fired", "invalidate"): "invalidated",
}
ENDED = {"done", "cancelled", "expired", "invalidated"}


def once(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Events (id, at, ...) without those whose id came before.

    Identifiers are kept for good, on disk if the session's state store is; with a delay, that of an id is dropped once
    the watermark is past it.
    """
    if delay is None:
        return events.dropDuplicates(["id"])
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])


def _used(gap: float):
    def run(key: tuple[Any, ...], frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, None)
        for at in sorted(t for f in frames for t in f["at"].astype("datetime64[us]").astype("int64")):
            if last is None or at - last > gap:
                count, last = count + 1, at
        state.update((int(count), int(last)))
        yield pd.DataFrame({"id": [key[0]], "uses": [int(count)], "last_us": [int(last)]})

    return run


def uses(touches: DataFrame, gap_s: float = 3600) -> DataFrame:
    """(id, uses, last_us) after each batch of touches (id, at): a touch counts if more than a gap has passed since the last that counted."""
    return touches.groupBy("id").applyInPandasWithState(_used(gap_s * 1e6), "id long, uses long, last_us long", "uses long, last_us long", "update", GroupStateTimeout.NoTimeout)


def by_hour(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(hour, kind, n) of events (kind, at); late ones count until the watermark has passed their hour."""
    return events.withWatermark("at", delay).groupBy(F.window("at", "1 hour").getField("start").alias("hour"), "kind").agg(F.count(F.lit(1)).alias("n"))


def _advance(cooldown: float, max_fires: int | None):
    def run(key: tuple[Any, ...], frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, fires, refused, last = state.get if state.exists else ("pending", 0, 0, None)
        for at, event in sorted((t, e) for f in frames for t, e in zip(f["at"].astype("datetime64[us]").astype("int64"), f["event"], strict=True)):
            if now in ENDED:
                continue
            early = event == "fire" and (max_fires is not None and fires >= max_fires or last is not None and at - last < cooldown)
            if early or (now, event) not in TRANSITIONS:
                refused += 1
                continue
            now = TRANSITIONS[now, event]
            if event == "fire":
                fires, last = fires + 1, int(at)
        state.update((now, int(fires), int(refused), last))
        yield pd.DataFrame({"id": [key[0]], "state": [now], "fires": [int(fires)], "refused": [int(refused)]})

    return run


def intentions(events: DataFrame, cooldown_s: float = 0, max_fires: int | None = None) -> DataFrame:
    """(id, state, fires, refused) after each batch of a stream of events (id, at, event).

    An intention's events of a batch are taken in order of time. An event that its state does not allow is counted as
    refused, and so is a firing within the cooldown of the last or beyond max_fires; one that has ended takes no more.
    The state of an intention is a word, two counts and a time.
    """
    kind = "state string, fires int, refused int"
    return events.groupBy("id").applyInPandasWithState(_advance(cooldown_s * 1e6, max_fires), f"id long, {kind}", f"{kind}, last_us long", "update", GroupStateTimeout.NoTimeout)


def merged_intentions(replicas: DataFrame) -> DataFrame:
    """(id, state, updated_at, fires) of copies (id, state, updated_at, fires) from several hosts, in whatever order they are merged.

    The latest copy holds; of equally late ones, an ended one, then the greater state by name. Firings are the most any has seen.
    """
    key = F.struct("updated_at", F.col("state").isin(*ENDED), "state")
    return replicas.groupBy("id").agg(F.max(key).alias("k"), F.max("fires").alias("fires")).select("id", "k.state", "k.updated_at", "fires")


def next_slot(due, step: int, now):
    """The first slot of a repeating timer after now: however long it was down, it fires once."""
    return F.when(due > now, due).otherwise(due + step * (F.floor((now - due) / step) + 1))


def due(timers: DataFrame, now: str, most: int | None = None) -> DataFrame:
    """Timers (id, state, due_at, snooze_until) that are to fire at a time, in order; at most so many of them."""
    t = F.lit(now).cast("timestamp")
    ready = F.col("state").isin("pending", "armed") & (F.col("due_at") <= t) & (F.col("snooze_until").isNull() | (F.col("snooze_until") <= t))
    rows = timers.where(ready).orderBy("due_at", "id")
    return rows if most is None else rows.limit(most)


def invalidated(live: DataFrame, records: DataFrame) -> DataFrame:
    """Events that end intentions (id, origin_id, state) whose record (id, valid_to) has closed; a stream joins the records as they are."""
    closed = records.where("valid_to is not null").select(F.col("id").alias("origin_id"), F.col("valid_to").alias("at"))
    return live.where(~F.col("state").isin(*ENDED)).join(closed, "origin_id").select("id", "at", F.lit("invalidate").alias("event"))
