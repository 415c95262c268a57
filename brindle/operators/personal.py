"""Preferences learned from graded rows and tried on rows that they have not seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.filters import adjusted
from brindle.operators.metrics import ranking_metrics

# Graded rows behind a preference, the most that one may move a score, and grades a fold needs to be judged.
LEAST_EVIDENCE, MOST_WEIGHT, LEAST_HELD_OUT = 3, 0.3, 30


def fold_weights(graded: DataFrame, traits: DataFrame, folds: int, least: int = LEAST_EVIDENCE, most: float = MOST_WEIGHT) -> DataFrame:
    """graded(key, fold, grade), traits(key, trait) -> fold, trait, weight, learned from all folds but that one.

    A weight is how far the mean grade of a trait's rows lies from that of all
    rows, at most `most` either way, from `least` rows on. Sums are taken once,
    for each trait and fold; what the other folds say is a trait's total less
    its own part, so no row is read once a fold.
    """
    sums = (F.sum("grade").alias("s"), F.count("*").alias("n"))
    parts = graded.join(traits, "key").groupBy("trait", "fold").agg(*sums)
    whole = parts.groupBy("trait").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    every = whole.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(folds)])))
    rest = every.join(parts, ["trait", "fold"], "left").select("trait", "fold", (F.col("ts") - F.coalesce("s", F.lit(0))).alias("s"), (F.col("tn") - F.coalesce("n", F.lit(0))).alias("n"))
    all_parts = graded.groupBy("fold").agg(*sums)
    total = all_parts.agg(F.sum("s").alias("as_"), F.sum("n").alias("an"))  # one row
    means = all_parts.crossJoin(F.broadcast(total)).select("fold", F.try_divide(F.col("as_") - F.col("s"), F.col("an") - F.col("n")).alias("mean"))  # a row a fold
    weight = F.greatest(F.least(F.col("s") / F.col("n") - F.col("mean"), F.lit(most)), F.lit(-most))
    return rest.where(F.col("n") >= least).join(F.broadcast(means), "fold").select("fold", "trait", weight.alias("weight"))


def held_out_ranking(graded: DataFrame, traits: DataFrame, folds: int, k: int = 10) -> DataFrame:
    """graded(key, fold, score, grade), traits(key, trait) -> fold, n, base_ndcg, personal_ndcg, status.

    Every fold is ranked by score and by the score moved by the weights that
    the other folds give its traits. A fold under LEAST_HELD_OUT grades is
    "insufficient"; otherwise it is "better" or "no better".
    """
    weights = fold_weights(graded, traits, folds)
    moved = graded.select("key", "fold").join(traits, "key").join(weights, ["fold", "trait"]).groupBy("key").agg(F.sum("weight").alias("w"))
    rows = graded.join(moved, "key", "left").select("key", "fold", "grade", "score", adjusted(F.col("score"), F.coalesce("w", F.lit(0.0))).alias("personal"))
    judged = lambda c: ranking_metrics(rows.select(F.col("fold").alias("query"), "key", F.round(c, 6).alias("score"), F.col("grade").alias("relevance")), k).select(F.col("query").alias("fold"), F.col("ndcg_at_k").alias(f"{c}_ndcg"))
    out = graded.groupBy("fold").agg(F.count("*").alias("n")).join(judged("score").withColumnRenamed("score_ndcg", "base_ndcg"), "fold").join(judged("personal"), "fold")
    status = F.when(F.col("n") < LEAST_HELD_OUT, "insufficient").when(F.round("personal_ndcg", 6) > F.round("base_ndcg", 6), "better").otherwise("no better")
    return out.withColumn("status", status)
