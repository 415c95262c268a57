"""Snapshots into tables: upsert, close, versions, retention, and audits of states and leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, seen: DataFrame, key: list[str], hash_col: str, at: Column) -> DataFrame:
    """stored(key, hash, first_seen_at, last_seen_at, closed_at, ...) and a snapshot -> the table after it, with change in new / changed / same / absent.

    A seen row opens again and is refreshed; first_seen_at stays. Rows absent
    from the snapshot stay as they are. One full outer join, no row loop.
    """
    cols = [c for c in seen.columns if c not in key]
    s = stored.select(*key, *[F.col(c).alias(f"_s_{c}") for c in stored.columns if c not in key], F.lit(True).alias("_have"))
    j = s.join(seen.withColumn("_seen", F.lit(True)), key, "full_outer")
    change = F.when(F.col("_seen").isNull(), "absent").when(F.col("_have").isNull(), "new").when(F.col(f"_s_{hash_col}").eqNullSafe(F.col(hash_col)), "same").otherwise("changed")
    value = [F.when(F.col("_seen"), F.col(c)).otherwise(F.col(f"_s_{c}")).alias(c) for c in cols]
    return j.select(
        *key,
        *value,
        F.coalesce("_s_first_seen_at", at).alias("first_seen_at"),
        F.when(F.col("_seen"), at).otherwise(F.col("_s_last_seen_at")).alias("last_seen_at"),
        F.when(F.col("_seen").isNull(), F.col("_s_closed_at")).alias("closed_at"),
        change.alias("change"),
    )


def close_missing(table: DataFrame, by: str, at: Column) -> DataFrame:
    """Close open rows not seen at `at`; a group that saw nothing at all while rows are open is suspect and closes none."""
    w = Window.partitionBy(by)
    seen_any = F.max((F.col("last_seen_at") >= at).cast("int")).over(w) == 1
    missing = F.col("closed_at").isNull() & (F.col("last_seen_at") < at)
    return table.withColumn("suspect", missing & ~seen_any).withColumn("closed_at", F.when(missing & seen_any, at).otherwise(F.col("closed_at")))


def new_versions(table: DataFrame, versions: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Version rows to append: next number for new or changed rows; an unversioned row gets its baseline."""
    last = versions.groupBy(*key).agg(F.max("version").alias("_last"))
    return table.where(F.col("change").isin("new", "changed")).join(last, key, "left").select(*key, (F.coalesce("_last", F.lit(0)) + 1).alias("version"), *fields)


def retained(table: DataFrame, now: Column, days: int, owned: DataFrame, key: list[str]) -> DataFrame:
    """table with keep: open and fresh rows, and rows that somebody owns."""
    old = F.coalesce("closed_at", "last_seen_at") < now - F.make_dt_interval(F.lit(days))
    j = table.join(owned.select(*key).distinct().withColumn("_own", F.lit(True)), key, "left")
    return j.withColumn("keep", F.col("_own").isNotNull() | ~old).drop("_own")


def inserted_once(have: DataFrame, more: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows of more whose key have lacks, the first of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = more.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return first.join(have.select(*key), key, "left_anti")


def illegal_steps(log: DataFrame, by: str, order: list[str], state: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Steps of an append-only log that the state machine does not allow, counted by (from, to)."""
    w = Window.partitionBy(by).orderBy(*order)
    s = log.withColumn("from_state", F.lag(state).over(w)).where(F.col("from_state").isNotNull())
    edges = [f"{a}>{b}" for a, bs in allowed.items() for b in bs]
    return s.where(~F.concat(F.col("from_state"), F.lit(">"), F.col(state)).isin(*edges)).groupBy("from_state", F.col(state).alias("to_state")).agg(F.count("*").alias("n"))


def retry_delay(attempts: Column, base: float, most: float) -> Column:
    """min(base * 2^(attempts - 1), most)."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempts - 1), F.lit(most))
