"""Filters that explain themselves, three-valued logic, shares and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reasons(checks: dict[str, Column]) -> Column:
    """Names of all checks that a row fails. A check that is null (unknown) fails too."""
    every = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return F.filter(F.array(*every), lambda x: x.isNotNull())


def or_unknown(check: Column, include: bool) -> Column:
    """A check that lets unknown pass if so asked."""
    return F.coalesce(check, F.lit(True)) if include else check


def and3(*checks: Column) -> Column:
    """Three-valued AND: false over unknown over true."""
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return out


def shares(df: DataFrame, group: str, matching: Column, top: int, other: str = "other", unclassified: str = "unclassified") -> DataFrame:
    """group -> total, matching and share of the `top` largest groups, the rest as other, null as unclassified; a share of nothing is null."""
    g = df.groupBy(group).agg(F.count("*").alias("total"), F.sum(matching.cast("long")).alias("matching"))
    w = Window.orderBy(F.col(group).isNull(), F.col("total").desc(), F.col(group))
    name = F.when(F.col(group).isNull(), unclassified).when(F.row_number().over(w) <= top, F.col(group)).otherwise(other)
    return g.withColumn("name", name).groupBy("name").agg(F.sum("total").alias("total"), F.sum("matching").alias("matching")).withColumn("share", F.try_divide(F.col("matching"), F.col("total")))


def collapsed(df: DataFrame, group: str, order: list[Column], hidden: Column) -> DataFrame:
    """One row a group, the first by order, unless any row of it is hidden."""
    w = Window.partitionBy(group).orderBy(*order)
    every = Window.partitionBy(group)
    return df.withColumn("_hide", F.max(hidden.cast("int")).over(every)).withColumn("copies", F.count("*").over(every)).withColumn("_rn", F.row_number().over(w)).where("_hide = 0 and _rn = 1").drop("_hide", "_rn")


def weighted_rubric(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of 1 to 5 grades; an unknown grade has no weight; null if all are unknown."""
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts.values()), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts.values()), F.lit(0.0))
    return F.try_divide(total, weight)


def adjusted(score: Column, weights: Column, most: float = 0.5) -> Column:
    """score plus clamped weights, clamped to 0..1."""
    return F.greatest(F.least(score + F.greatest(F.least(weights, F.lit(most)), F.lit(-most)), F.lit(1.0)), F.lit(0.0))


def top_excerpt(text: Column, words: list[str], width: int = 200) -> Column:
    """The sentence of a text with the most different wanted words, the first of several, clipped to width."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+|\n"), lambda s: F.trim(s) != "")
    hits = lambda s: sum((F.lower(s).contains(w).cast("int") for w in words), F.lit(0))
    scored = F.transform(sentences, lambda s, i: F.struct(hits(s).alias("hits"), (-i).alias("at"), F.substring(F.trim(s), 1, width).alias("s")))
    return F.array_max(scored)["s"]
