"""A store of one active task for each scope, kept for a time, as arbitrary state of a stream.

Events save, update, clear or load a scope's task.  A task goes when its time is over: by a
timer of event time, or by the next event of its scope if that comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ACTIONS = ("save", "update", "clear", "load")
#: What comes out: a row for each load (found or absent) and one for each task whose time was over.
OUTCOME = "scope string, seq long, outcome string, task string, payload double, at_us long"
_TASK = "task string, payload double, expires_us long"
#: Spark keeps state with timers in RocksDB.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TaskStore(StatefulProcessor):
    def __init__(self, lifetime_us: int):
        self.lifetime_us = lifetime_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.task = handle, handle.getValueState("task", _TASK)

    @staticmethod
    def _millis(us: int) -> int:
        """The first millisecond at which the task's time is over."""
        return -(-us // 1000)

    def _get(self) -> tuple[str, float, int] | None:
        return self.task.get() if self.task.exists() else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        """The scope's events in order of time, then number; state and timer are read before and written after all of them."""
        frames = list(rows)
        events = frames[0] if len(frames) == 1 else pd.concat(frames)
        before = held = self._get()
        out = []
        for us, seq, action, task, payload in sorted(zip(*(events[c].tolist() for c in ("us", "seq", "action", "task", "payload")), strict=True), key=lambda e: e[:2]):
            if held is not None and held[2] <= us:
                out.append((key[0], None, "expired", held[0], held[1], held[2]))
                held = None
            if action == "save":
                held = (task, payload, us + self.lifetime_us)
            elif action == "update" and held is not None:
                held = (held[0], payload, held[2])
            elif action == "clear":
                held = None
            elif action == "load":
                out.append((key[0], seq, "found" if held else "absent", held[0] if held else None, held[1] if held else None, us))
        if held != before:
            self._keep(before, held)
        yield self._frame(out)

    def _keep(self, before: tuple | None, held: tuple | None) -> None:
        old, new = (None if t is None else self._millis(t[2]) for t in (before, held))
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if held is None:
            self.task.clear()
            return
        self.task.update(held)
        if old != new:
            self.handle.registerTimer(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        held, out = self._get(), []
        if held is not None and self._millis(held[2]) <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], None, "expired", held[0], held[1], held[2]))
            self.task.clear()
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["scope", "seq", "outcome", "task", "payload", "at_us"])
        return frame.astype({"seq": "Int64", "payload": "Float64", "at_us": "Int64"})

    def close(self) -> None:
        pass


def task_outcomes(events: DataFrame, *, lifetime: timedelta = timedelta(days=7), delay: str = "1 hour") -> DataFrame:
    """Loads' outcomes and expiries of a stream of (scope, ts, seq, action, task, payload).

    A save replaces what the scope has and gives it its full time; an update changes the
    payload and not the time, and does nothing where there is no task; a clear forgets;
    a load finds the task or nothing.  At the very time of expiry the task is gone.
    Events later than the watermark (``delay`` behind the latest) are dropped; events of
    one batch are taken in order.  Rows with a null scope or time are left out; unknown
    actions do nothing but let a task's time run out.
    """
    events.sparkSession.conf.set(_PROVIDER, _ROCKS)
    named = events.filter("scope is not null and ts is not null").withColumn("us", F.unix_micros("ts")).withColumn("payload", F.col("payload").cast("double"))
    lifetime_us = int(lifetime / timedelta(microseconds=1))
    grouped = named.withWatermark("ts", delay).groupBy("scope")
    return grouped.transformWithStateInPandas(TaskStore(lifetime_us), OUTCOME, "Append", "EventTime")
