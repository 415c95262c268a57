"""Ranks, fusion, quotas and top-k, each with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(df: DataFrame, by: list[str], score: str, key: str, name: str = "rank") -> DataFrame:
    """1-based rank by falling score, ties by key, inside `by`."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(key))))


def average_ranks(df: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """Ascending ranks; ties share their mean rank."""
    w = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def fuse(rankings: list[DataFrame], by: list[str], key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (by, key, rank) tables: the sum of 1 / (k + rank); a table without the key adds nothing."""
    parts = [r.select(*by, key, (1.0 / (k + F.col("rank"))).alias("part")) for r in rankings]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*by, key).agg(F.sum("part").alias("score"))


def fuse_neutral(main: DataFrame, other: DataFrame, by: list[str], key: str, k: int = RRF_K) -> DataFrame:
    """Fusion over the keys of main only; a key that other does not rank takes the middle rank (n + 1) / 2."""
    n = F.count("*").over(Window.partitionBy(*by))
    both = main.withColumn("_n", n).join(other.select(*by, key, F.col("rank").alias("_other")), [*by, key], "left")
    rank2 = F.coalesce(F.col("_other").cast("double"), (F.col("_n") + 1) / 2.0)
    return both.select(*by, key, (1.0 / (k + F.col("rank")) + 1.0 / (k + rank2)).alias("score"))


def interleave(rankings: list[DataFrame], by: list[str], key: str) -> DataFrame:
    """Round robin over rankings by rank; a key stands where it first appears."""
    every = None
    for i, r in enumerate(rankings):
        part = r.select(*by, key, "rank", F.lit(i).alias("space"))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy(*by, key).agg(F.min(F.struct("rank", "space")).alias("at"))
    w = Window.partitionBy(*by).orderBy("at.rank", "at.space")
    return first.select(*by, key, F.row_number().over(w).alias("place"))


def largest_remainder(shares: DataFrame, total: int, name: str = "stream", weight: str = "weight") -> DataFrame:
    """Split total over few weighted streams: whole parts first, then one more to the largest remainders, ties by name."""
    every = Window.partitionBy(F.lit(1))
    exact = F.lit(total) * F.col(weight) / F.sum(weight).over(every)
    s = shares.withColumn("_exact", exact).withColumn("_whole", F.floor("_exact"))
    left = F.lit(total) - F.sum("_whole").over(every)
    turn = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy((F.col("_exact") - F.col("_whole")).desc(), name))
    s = s.withColumn("_left", left).withColumn("_turn", turn)
    return s.select(name, (F.col("_whole") + F.when(F.col("_turn") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("quota"))


def stable_order(version: str, *key: Column) -> Column:
    """A shuffle that never changes: the first three bytes of sha256 of version and key."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(version), *key), 256), 1, 6), 16, 10).cast("long")


def held_out(version: str, percent: int, *key: Column) -> Column:
    """True for about percent of keys, by the first byte of the same digest."""
    first = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(version), *key), 256), 1, 2), 16, 10).cast("long")
    return F.floor(first * 100 / 256) < percent
