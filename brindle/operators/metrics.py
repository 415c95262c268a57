"""Ranking, classification and agreement metrics over (query, score, relevance) tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.ranking import average_ranks
from brindle.session import written


def ranking_metrics(judged: DataFrame, k: int = 10, by: str = "query") -> DataFrame:
    """judged(by, key, score, relevance) -> one row a query: p_at_k, recall_at_k, hit_at_k, ap, rr, ndcg_at_k.

    Ties go against the ranking: the less relevant comes first, then the key.
    Precision divides by k even for a shorter list; what has no relevant item
    scores 0.
    """
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), "relevance", "key")
    best = Window.partitionBy(by).orderBy(F.col("relevance").desc(), "key")
    rel = (F.col("relevance") > 0).cast("int")
    r = judged.withColumn("rank", F.row_number().over(w)).withColumn("ideal", F.row_number().over(best))
    r = r.withColumn("hits", F.sum(rel).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    dcg = lambda place: F.sum(F.when(F.col(place) <= k, gain / F.log2(F.col(place) + 1.0)).otherwise(0.0))
    top = F.sum(F.when(F.col("rank") <= k, rel).otherwise(0))
    out = r.groupBy(by).agg(
        top.alias("top"),
        F.sum(rel).alias("relevant"),
        F.sum(F.when(F.col("relevance") > 0, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias("first"),
        dcg("rank").alias("dcg"),
        dcg("ideal").alias("idcg"),
    )
    safe = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return out.select(
        by,
        (F.col("top") / k).alias("p_at_k"),
        safe(F.col("top"), F.col("relevant")).alias("recall_at_k"),
        (F.col("top") > 0).cast("double").alias("hit_at_k"),
        safe(F.col("precisions"), F.col("relevant")).alias("ap"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        safe(F.col("dcg"), F.col("idcg")).alias("ndcg_at_k"),
    )


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """scored(score, label) -> one row: counts and rates at score >= threshold; a rate over nothing is 0."""
    p, y = F.col("score") >= threshold, F.col("label") == 1
    n = lambda c: F.sum(c.cast("long"))
    c = scored.agg(n(p & y).alias("tp"), n(p & ~y).alias("fp"), n(~p & y).alias("fn"), n(~p & ~y).alias("tn"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe(fp, fp + tn).alias("fpr"), safe(fn, fn + tp).alias("fnr"))


def _by_score(scored: DataFrame) -> DataFrame:
    """score -> pos, neg: one row a distinct score, so running sums never see the rows themselves."""
    return scored.groupBy("score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))


def running_totals(rows: DataFrame, order: str, columns: list[str], descending: bool = False, ranges: int = 256) -> DataFrame:
    """rows with before_<column>: the sum of a column over all rows before, in the order of a number.

    Rows are dealt into equal ranges of the number; sums inside a range meet the
    totals of the ranges before it (a row a range), so no task sees all rows.
    Values of `order` must be distinct.
    """
    edge = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    lo, width = float(edge.lo or 0), max(float((edge.hi or 0) - (edge.lo or 0)), 1e-12)
    at = F.least(F.floor((F.col(order) - lo) / width * ranges), F.lit(ranges - 1))
    r = rows.withColumn("_range", -at if descending else at)
    key = F.col(order).desc() if descending else F.col(order)
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = r.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_t_{c}").over(over), F.lit(0)).alias(f"_b_{c}") for c in columns])
    r = r.join(F.broadcast(totals), "_range")  # at most `ranges` rows
    for c in columns:
        r = r.withColumn(f"before_{c}", F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_b_{c}"))
    return r.drop("_range", *[f"_b_{c}" for c in columns])


def roc_auc(scored: DataFrame) -> DataFrame:
    """Mann-Whitney area with ties halved; null without both classes."""
    s = running_totals(_by_score(scored), "score", ["neg"])
    return s.agg(F.try_divide(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0)), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def pr_auc(scored: DataFrame) -> DataFrame:
    """Step area under precision and recall, ties as one step; null without a positive."""
    s = running_totals(_by_score(scored), "score", ["pos", "neg"], descending=True)
    tp = F.col("before_pos") + F.col("pos")
    return s.agg(F.try_divide(F.sum(F.col("pos") * tp / (tp + F.col("before_neg") + F.col("neg"))), F.sum("pos")).alias("pr_auc"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """ece over equal bins (the last closed) and brier of probabilities."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    per = scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("conf"), F.avg("label").alias("acc"), F.sum(F.pow(F.col("score") - F.col("label"), 2)).alias("sq"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"))


def spearman(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Correlation of tie-averaged ranks of a and b inside each group."""
    r = average_ranks(average_ranks(pairs, by, a, "_ra"), by, b, "_rb")
    return r.groupBy(*by).agg(F.corr("_ra", "_rb").alias("spearman"), F.count("*").alias("n"))


#: Rows that one task counts inversions of, while there are so few.
CHUNK = 200_000


def _inversions(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> float:
    """Weight of pairs with a rising and b falling: merge counting, all blocks of a level at once."""
    order = np.lexsort((b, a))
    b, n = b[order], n[order].astype(np.float64)
    rising = np.argsort(b, kind="stable")
    total, size = 0.0, 1
    while size < len(b):
        # pairs of neighbouring blocks, by b inside a pair
        at = rising[np.argsort(rising // (2 * size), kind="stable")]
        pair, left = at // (2 * size), (at // size) % 2 == 0
        upto = np.cumsum(np.where(left, n[at], 0.0))
        ends = np.r_[pair[1:] != pair[:-1], True]
        alike_ends = ends | np.r_[b[at][1:] != b[at][:-1], True]
        of_pair = np.flatnonzero(ends)[np.cumsum(np.r_[0, ends[:-1]])]
        of_alike = np.flatnonzero(alike_ends)[np.cumsum(np.r_[0, alike_ends[:-1]])]
        total += float((np.where(left, 0.0, n[at]) * (upto[of_pair] - upto[of_alike])).sum())
        size *= 2
    return total


def inversions(cells: DataFrame, by: list[str], a: str, b: str, chunk: int = CHUNK) -> DataFrame:
    """cells(by, a, b, n), each (a, b) once a group -> by, inversions: the weight of pairs of cells with a rising and b falling.

    Cells are dealt into chunks of the order (a, b) and into buckets of the
    order (b, a). A pair falls in one chunk, or in one bucket, or in neither;
    pairs in neither are inversions of (chunk, bucket) counts, which are fewer
    and are counted in the same way. Chunks and buckets are ranges over all
    groups, so a large group, or many ties, are spread over tasks. n log n in all.
    """
    keys = [F.col(k) for k in by]
    rows = cells.select(*by, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.col("n").cast("double").alias("n"))
    shape = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by)

    def counted(rows: DataFrame, part: list[str]) -> DataFrame:
        def run(x: pd.DataFrame) -> pd.DataFrame:
            return x[by].iloc[:1].assign(d=_inversions(x["a"].to_numpy(), x["b"].to_numpy(), x["n"].to_numpy()))

        return rows.groupBy(*by, *part).applyInPandas(run, f"{shape}, d double")

    total = rows.count()
    if total <= chunk:
        parts = counted(rows, [])
    else:
        pieces = max(2, min(-(-total // chunk), int(total**0.5 / 4)))
        rows = written(rows.repartitionByRange(pieces, *keys, "a", "b").withColumn("chunk", F.spark_partition_id()), "chunks")
        rows = written(rows.repartitionByRange(pieces, *keys, "b", "a").withColumn("bucket", F.spark_partition_id()), "buckets")
        inside = counted(rows, ["chunk"])
        beside = counted(rows.select(*by, "bucket", F.col("chunk").cast("double").alias("a"), "b", "n"), ["bucket"])
        far = written(rows.groupBy(*by, "chunk", "bucket").agg(F.sum("n").alias("n")), "far")
        parts = inside.union(beside).union(inversions(far, by, "chunk", "bucket", chunk).withColumnRenamed("inversions", "d"))
    return parts.groupBy(*by).agg(F.sum("d").alias("inversions"))


def kendall_tau(pairs: DataFrame, by: list[str], a: str, b: str, chunk: int = CHUNK) -> DataFrame:
    """Kendall's tau-b in each group, ties and all, from inversions of distinct (a, b) cells; null where a side has one value only.

    Rows with a null on either side count for nothing.
    """
    c = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("n"))
    c = written(c, "cells")
    two = lambda name: F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias(name)
    ties = lambda by_, name: c.groupBy(*by, by_).agg(F.sum("n").alias("n")).groupBy(*by).agg(two(name))
    whole = c.groupBy(*by).agg((F.sum("n").cast("double") * (F.sum("n") - 1) / 2).alias("t"), two("tab"))
    s = whole.join(ties("_a", "ta"), by).join(ties("_b", "tb"), by).join(inversions(c, by, "_a", "_b", chunk), by)
    net = F.col("t") - F.col("ta") - F.col("tb") + F.col("tab") - 2 * F.col("inversions")
    return s.select(*by, F.try_divide(net, F.sqrt(F.col("t") - F.col("ta")) * F.sqrt(F.col("t") - F.col("tb"))).alias("kendall_tau"))


#: Distribution of a Poisson variable of mean 1: the chance of at most 0, 1, 2 ... draws.
POISSON = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885)


def bootstrap_interval(values: DataFrame, key: str, column: str, rounds: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile interval of a mean by the Poisson bootstrap: one pass, no resampled copies of the rows.

    A row's digest gives a start and a step; round r takes the row as often as
    Poisson(1) says at start + (2r + 1) steps, modulo 1. So rounds are sums that
    combine before the shuffle, and reruns agree however rows are dealt.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    number = lambda a: F.conv(F.substring(digest, a, 8), 16, 10).cast("long")
    rows = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"), number(1).alias("step"), number(9).alias("start"))
    rows = rows.select("v", "step", "start", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    u = F.pmod(F.col("start") + F.col("step") * (2 * F.col("round") + 1), F.lit(1 << 32)).cast("double") / float(1 << 32)
    drawn = sum(((u >= t).cast("int") for t in POISSON), F.lit(0))
    sums = rows.select("round", "v", drawn.alias("w")).groupBy("round").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean"))
    tail = (1 - level) / 2
    return sums.agg(F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"), F.avg("mean").alias("centre"))


def paired_compare(scores: DataFrame, base: str, other: str) -> DataFrame:
    """scores(query, base, other) -> means, mean difference, questions lost and gained."""
    d = F.col(other) - F.col(base)
    n = lambda c: F.sum(c.cast("long"))
    return scores.agg(F.avg(base).alias("base_mean"), F.avg(other).alias("other_mean"), F.avg(d).alias("difference"), n(d < 0).alias("lost"), n(d > 0).alias("gained"), F.count("*").alias("n"))
