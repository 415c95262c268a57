"""Streams that keep state with timers: request budgets and reminders."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, while streams are started inside."""
    had = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if had is None else spark.conf.set(_PROVIDER, had)


class _Budget(StatefulProcessor):
    """Two numbers a user: when the window opened, and what it has allowed. A timer at its end takes them away."""

    def __init__(self, seconds: float, most: int):
        self.seconds, self.most = seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened double, used long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        opened, used = self.window.get() if self.window.exists() else (None, 0)
        x = pd.concat(list(rows)).sort_values(["at", "event_id"])  # a trigger's rows of one user
        allowed = []
        for at in x["at"]:
            if opened is None or at - opened >= self.seconds:
                opened, used = at, 0
            allowed.append(used < self.most)
            used += allowed[-1]
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(int((opened + self.seconds) * 1000))
        self.window.update((opened, used))
        yield pd.DataFrame({"user_id": key[0], "event_id": x["event_id"], "at": x["at"], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def budgeted_stream(events: DataFrame, seconds: float, most: int, late: str = "1 hour") -> DataFrame:
    """What operators.tracking.budgeted marks, on a stream(user_id, event_id, ts) whose triggers come in order of time: user_id, event_id, at, allowed.

    Rows later than the watermark are dropped, so a window that has ended below
    it cannot be asked for again, and its state goes.
    """
    e = events.select(F.col("user_id").cast("long"), F.col("event_id").cast("long"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    e = e.select("user_id", "event_id", "ts", F.col("ts").cast("double").alias("at"))
    return e.groupBy("user_id").transformWithStateInPandas(_Budget(seconds, most), "user_id long, event_id long, at double, allowed boolean", "Append", "EventTime")


class _Reminder(StatefulProcessor):
    """What is promised and not yet answered: its hour, and a timer for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "due double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows)).sort_values(["at", "due"], na_position="last")
        for at, due in zip(x["at"], x["due"]):
            if self.due.exists():
                self.handle.deleteTimer(int(self.due.get()[0] * 1000))
                self.due.clear()
            if not pd.isna(due):  # a promise; an answer has none
                self.due.update((due,))
                self.handle.registerTimer(int(due * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.due.get()[0] if self.due.exists() else None
        self.due.clear()
        if due is not None:
            yield pd.DataFrame({"item": [key[0]], "due": [due]})

    def close(self) -> None:
        pass


def reminders_stream(told: DataFrame, late: str = "0 seconds") -> DataFrame:
    """told(item, ts, due): a promise has a due time, an answer a null one -> item, due of promises that nothing has followed when time (the watermark) passes their hour.

    A later promise takes the place of an earlier one. Each rings once.
    """
    t = told.select(F.col("item").cast("long"), F.col("ts").cast("timestamp").alias("ts"), F.col("due").cast("timestamp").cast("double").alias("due")).withWatermark("ts", late)
    t = t.select("item", "ts", "due", F.col("ts").cast("double").alias("at"))
    return t.groupBy("item").transformWithStateInPandas(_Reminder(), "item long, due double", "Append", "EventTime")
