"""Streams of events: windows, sessions, deduplicated tails, rates and state. Each also runs on a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_stream_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks take timestamps with a zone only."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each kind in tumbling windows."""
    e = as_stream_time(events)
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with pauses below gap."""
    e = as_stream_time(events)
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def tail(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, although readers overlap: repeated ids inside the watermark are dropped."""
    e = as_stream_time(events)
    return e.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if e.isStreaming else e.dropDuplicates(["event_id"])


_STATE = "last_allowed double, refused long"
_OUT = "user_id long, event_id long, at double, allowed boolean"


def spaced(events: DataFrame, seconds: float) -> DataFrame:
    """Marks events of a key that come sooner than `seconds` after the last allowed one.

    A stream keeps one number a key; a batch walks sorted rows, so it also
    holds one number, however many events a key has.
    """
    e = as_stream_time(events).select("user_id", "event_id", F.col("ts").cast("double").alias("at"))

    def walk(rows: pd.DataFrame, last: float | None):
        rows = rows.sort_values(["at", "event_id"])
        allowed = []
        for at in rows["at"]:
            ok = last is None or at - last >= seconds
            last = at if ok else last
            allowed.append(ok)
        return rows.assign(allowed=allowed), last

    def run(batches):
        user, last, begun = None, None, False
        for batch in batches:
            allowed = []
            for u, at in zip(batch.column("user_id").to_pylist(), batch.column("at").to_pylist()):
                if not begun or u != user:
                    user, last, begun = u, None, True
                at = float("nan") if at is None else at
                ok = last is None or at - last >= seconds
                last = at if ok else last
                allowed.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_())], names=["user_id", "event_id", "at", "allowed"])

    if not e.isStreaming:
        e = e.select(F.col("user_id").cast("long"), F.col("event_id").cast("long"), "at")
        return e.repartition("user_id").sortWithinPartitions("user_id", F.asc_nulls_last("at"), F.asc_nulls_last("event_id")).mapInArrow(run, _OUT)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, refused = state.get if state.exists else (None, 0)
        out, last = walk(pd.concat(list(batches)), last)
        state.update((last, refused + int((~out["allowed"]).sum())))
        yield out[["user_id", "event_id", "at", "allowed"]]

    return e.groupBy("user_id").applyInPandasWithState(step, _OUT, _STATE, "append", "NoTimeout")


def trailing_rate(events: DataFrame, minutes: int) -> DataFrame:
    """Events of each kind in the last minutes before the newest event, and per minute."""
    e = as_stream_time(events)
    newest = e.agg(F.max("ts").alias("newest"))
    last = e.join(F.broadcast(newest)).where(F.col("ts") > F.col("newest") - F.make_dt_interval(mins=F.lit(minutes)))  # newest is one row
    return last.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("per_minute", F.round(F.col("n") / minutes, 6))
