"""Bookkeeping: survivors of merges, keepers, schedules, budgets, links with a margin."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_survivors(rows: DataFrame, key: list[str], age: list[str], closed: str) -> DataFrame:
    """key -> kept (the oldest row), newest (the youngest, whose content it takes), closed_at (the earliest), copies."""
    order, rest = F.struct(*age), F.struct(*[c for c in rows.columns if c not in key])
    return rows.groupBy(*key).agg(F.min_by(rest, order).alias("kept"), F.max_by(rest, order).alias("newest"), F.min(closed).alias("closed_at"), F.count("*").alias("copies"))


def board_keepers(boards: DataFrame, same: list[str], key: str, worth: Column) -> DataFrame:
    """boards -> key, keeper: of all boards alike in `same`, the one worth most stays, the smaller key on a tie."""
    b = boards.select(key, *same, worth.alias("_worth"))
    keep = b.groupBy(*same).agg(F.min(F.struct((-F.col("_worth")).alias("w"), F.col(key).alias("k"))).alias("t")).select(*same, F.col("t.k").alias("keeper"))
    return b.join(keep, same).select(key, "keeper")


def next_due(attempts: DataFrame, key: str, interval: int, most: int) -> DataFrame:
    """attempts(key, ts, bad) -> failures since the last success, and the second of the next attempt with doubled waits."""
    good = F.max(F.when(~F.col("bad"), F.col("ts")))
    last = attempts.groupBy(key).agg(F.max("ts").alias("last"), good.alias("good"))
    since = attempts.join(last, key).groupBy(key, "last").agg(F.count_if(F.col("good").isNull() | (F.col("ts") > F.col("good"))).alias("failures"))
    wait = F.least(F.lit(float(interval)) * F.pow(F.lit(2.0), F.col("failures")), F.lit(float(most))).cast("long")
    return since.select(key, "failures", (F.unix_timestamp("last") + wait).alias("next_due"))


def budgeted(events: DataFrame, seconds: float, most: int) -> DataFrame:
    """Marks events of a user above `most` in a window, which opens at its first event and ends `seconds` later.

    Rows stream through a task in order; two numbers of one user are held. A
    null time never opens a window anew.
    """
    e = events.select(F.col("user_id").cast("long"), F.col("event_id").cast("long"), F.col("ts").cast("timestamp").cast("double").alias("at"))

    def run(batches):
        user, begun, opened, used = None, False, None, 0
        for batch in batches:
            allowed = []
            for u, at in zip(batch.column("user_id").to_pylist(), batch.column("at").to_pylist()):
                if not begun or u != user:
                    user, begun, opened, used = u, True, None, 0
                if opened is None or (at is not None and at - opened >= seconds):
                    opened, used = at, 0
                ok = used < most
                used += ok
                allowed.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_())], names=["user_id", "event_id", "at", "allowed"])

    ordered = e.repartition("user_id").sortWithinPartitions("user_id", F.asc_nulls_last("at"), "event_id")
    return ordered.mapInArrow(run, "user_id long, event_id long, at double, allowed boolean")


def full_outer_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new (key, value) -> key, state: added, retired, changed or kept."""
    o, n = old.select(F.col("key").alias("ok"), F.col("value").alias("ov")), new.select(F.col("key").alias("nk"), F.col("value").alias("nv"))
    state = F.when(F.col("nk").isNull(), "retired").when(F.col("ok").isNull(), "added").when(~F.col("ov").eqNullSafe(F.col("nv")), "changed").otherwise("kept")
    return o.join(n, F.col("ok") == F.col("nk"), "full").select(F.coalesce("ok", "nk").alias("key"), state.alias("state"))


def best_link(scored: DataFrame, left: str, right: str, least: float, margin: float) -> DataFrame:
    """scored(left, right, score) -> the best right of each left, if it reaches `least` and beats the runner-up by `margin`."""
    w = Window.partitionBy(left).orderBy(F.col("score").desc(), right)
    r = scored.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    top = r.groupBy(left).agg(F.min_by(right, "_rn").alias(right), F.max("score").alias("score"), F.max(F.when(F.col("_rn") == 2, F.col("score"))).alias("second"))
    return top.where((F.col("score") >= least) & (F.col("score") - F.coalesce("second", F.lit(0.0)) >= margin)).select(left, right, "score")
