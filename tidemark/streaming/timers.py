"""Repeating timers and cooldowns as keyed state with timers of Spark's own.

Both need a state store that keeps timers, such as RocksDB (`spark.sql.streaming.stateStore.providerClass`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FIRED = "id long, slot timestamp, seen_at timestamp, fires int, missed long, ended boolean"


def _ms(values: pd.Series) -> list[int]:
    return [int(v) for v in values.astype("datetime64[ms]").astype("int64")]


def _fired(key: Any, slot: int, now: int, fires: int, missed: int, ended: bool) -> pd.DataFrame:
    at = pd.to_datetime([slot, now], unit="ms")
    return pd.DataFrame({"id": [key], "slot": [at[0]], "seen_at": [at[1]], "fires": [fires], "missed": [missed], "ended": [ended]})


def next_slot(due: int, step: int, now: int) -> tuple[int, int]:
    """The first slot after now, and how many slots were passed over since the one that is due."""
    passed = max(0, (now - due) // step)
    return due + step * (passed + 1), passed


class Repeating(StatefulProcessor):
    """A timer for each id, that fires at its slots; the state is the next slot, the step, and two counts.

    Time is the stream's watermark. However many slots have passed when it moves on, a timer fires once, says how many it
    missed, and is set to the first slot that is still to come. What is kept survives a restart, and so does the timer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "due long, step long, fires int, most int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            frame = frame.sort_values("at", kind="stable")
            for event, due, step, most in zip(frame["event"], _ms(frame["due_at"].fillna(pd.Timestamp(0))), frame["step_s"].fillna(0), frame["most"].fillna(0), strict=True):
                if event not in ("set", "cancel"):
                    continue
                if self.timer.exists():
                    self.handle.deleteTimer(self.timer.get()[0])
                    self.timer.clear()
                if event == "set":
                    self.timer.update((due, int(step) * 1000, 0, int(most)))
                    self.handle.registerTimer(due)
        yield _fired(0, 0, 0, 0, 0, False).iloc[:0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.timer.exists():
            return
        due, step, fires, most = self.timer.get()
        now = max(int(timerValues.getCurrentWatermarkInMs()), due)
        fires += 1
        ended = step <= 0 or (most > 0 and fires >= most)
        after, missed = (due, 0) if step <= 0 else next_slot(due, step, now)
        if ended:
            self.timer.clear()
        else:
            self.timer.update((after, step, fires, most))
            self.handle.registerTimer(after)
        yield _fired(key[0], due, now, fires, missed, ended)

    def close(self) -> None:
        pass


def repeating(commands: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(id, slot, seen_at, fires, missed, ended) of a stream of commands (id, at, event, due_at, step_s, most).

    Event "set" starts or replaces the timer of an id: first due at due_at, then every step_s seconds (0: once), most times at
    most (0 or null: no bound). "cancel" ends it; any other event only moves time on. Null ids have a timer of their own.
    """
    rows = commands.select("id", "at", "event", "due_at", "step_s", "most").withWatermark("at", delay)
    return rows.groupBy("id").transformWithStateInPandas(Repeating(), outputStructType=FIRED, outputMode="Update", timeMode="EventTime")


COOLED = "id long, at timestamp, fires int"


class Cooldown(StatefulProcessor):
    """Hits that fire: none within the cooldown of the last that did, and no more than the bound; a timer clears what is no longer needed."""

    def __init__(self, cooldown_ms: int, most: int | None) -> None:
        self.cooldown, self.most = cooldown_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, fires int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, fires = self.last.get() if self.last.exists() else (None, 0)
        out, before = [], last
        for at in sorted(t for f in rows for t in _ms(f["at"])):
            if (last is None or at - last >= self.cooldown) and (self.most is None or fires < self.most):
                last, fires = at, fires + 1
                out.append((at, fires))
        if out:
            if before is not None and self.most is None:
                self.handle.deleteTimer(before + self.cooldown)
            self.last.update((last, fires))
            if self.most is None:  # with a bound the count is kept for good
                self.handle.registerTimer(last + self.cooldown)
        yield pd.DataFrame({"id": [key[0]] * len(out), "at": pd.to_datetime([a for a, _ in out], unit="ms"), "fires": [n for _, n in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame({"id": pd.Series([], dtype="int64"), "at": pd.to_datetime([]), "fires": pd.Series([], dtype="int32")})

    def close(self) -> None:
        pass


def cooled(hits: DataFrame, cooldown_s: int, most: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """(id, at, fires) of a stream of hits (id, at): those that fire. Without a bound, fires starts anew once a cooldown has passed unused and its state is gone."""
    rows = hits.select("id", "at").withWatermark("at", delay)
    return rows.groupBy("id").transformWithStateInPandas(Cooldown(cooldown_s * 1000, most), outputStructType=COOLED, outputMode="Update", timeMode="EventTime")
