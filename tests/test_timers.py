"""Streams with timers give what their batch twins give, and let their state go."""

import datetime as dt
import random

from pyspark.sql import functions as F

from brindle.operators.tracking import budgeted
from brindle.streaming import timers

START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def streamed(spark, tmp_path, batches, schema, of):
    """Rows that a stream over one file a trigger gives, in order of the files."""
    folder = str(tmp_path / "in")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b={k}")
    spark.conf.set("spark.sql.streaming.schemaInference", "true")
    out, name = [], f"out{abs(hash(str(tmp_path)))}"
    with timers.timed_state(spark):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/*")
        q = of(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        out = spark.table(name).collect()
        progress = q.recentProgress
    return out, progress


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_budget_of_a_stream_is_that_of_a_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted((rng.randrange(8), k, at(rng.random() * 200)) for k in range(300))
    rows.sort(key=lambda r: r[2])
    batches = [rows[k : k + 60] for k in range(0, 300, 60)] + [[(99, 1000, at(400))], [(99, 1001, at(500))]]
    schema = "user_id long, event_id long, ts timestamp"
    got, progress = streamed(spark, tmp_path, batches, schema, lambda s: timers.budgeted_stream(s, 86400.0, 2))
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    want = {(r.user_id, r.event_id): r.allowed for r in budgeted(every, 86400.0, 2).collect()}
    assert {(r.user_id, r.event_id): r.allowed for r in got} == want and 0 < sum(want.values()) < len(want)
    assert progress[-1].stateOperators[0].numRowsTotal < 8 * 2  # windows that have ended are gone


def test_reminders_ring_once_unless_answered(spark, tmp_path):
    told = [
        [(1, at(0), at(10)), (2, at(0), at(10)), (3, at(1), at(300)), (4, at(1), at(10))],
        [(2, at(5), None), (4, at(6), at(40))],
        [(9, at(20), None)],
        [(9, at(60), None)],
        [(9, at(61), None)],
    ]
    got, _ = streamed(spark, tmp_path, told, "item long, ts timestamp, due timestamp", timers.reminders_stream)
    assert sorted((r.item, r.due) for r in got) == [(1, at(10).timestamp()), (4, at(40).timestamp())]
