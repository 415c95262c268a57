"""Multinomial Naive Bayes from counts, with Laplace smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import tokens


def train(rows: DataFrame, label: str, text: str, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """rows -> (classes: label, prior, unseen), (likelihoods: label, term, ll). All are grouped counts."""
    t = rows.select(F.col(label).alias("label"), tokens(F.col(text)).alias("tok"))
    docs = t.groupBy("label").agg(F.count("*").alias("docs"), F.sum(F.size("tok")).alias("words"))
    counts = t.select("label", F.explode("tok").alias("term")).groupBy("label", "term").agg(F.count("*").alias("n"))
    vocabulary = counts.select(F.count_distinct("term").alias("v"))
    whole = docs.agg(F.sum("docs").alias("all"))
    base = docs.crossJoin(vocabulary).crossJoin(whole)  # one row each
    denominator = F.col("words") + alpha * F.col("v")
    classes = base.select("label", F.log(F.col("docs") / F.col("all")).alias("prior"), F.log(F.lit(alpha) / denominator).alias("unseen"), denominator.alias("denominator"))
    ll = counts.join(classes.select("label", "denominator"), "label").select("label", "term", F.log((F.col("n") + alpha) / F.col("denominator")).alias("ll"))
    return classes.drop("denominator"), ll


def classify(rows: DataFrame, key: list[str], text: str, classes: DataFrame, ll: DataFrame) -> DataFrame:
    """rows -> key, predicted, score (log). Terms outside the vocabulary are skipped; a row without known terms takes the likeliest class by prior."""
    t = rows.select(*key, F.explode_outer(tokens(F.col(text))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    known = ll.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("label", "ll"))).alias("by"))
    # a term's entry has one number a class; classes are few
    s = t.join(known, "term", "left").join(F.broadcast(classes))
    part = F.when(F.col("by").isNotNull(), F.col("tf") * F.coalesce(F.try_element_at("by", "label"), F.col("unseen"))).otherwise(0.0)
    s = s.groupBy(*key, "label", "prior").agg(F.sum(part).alias("s")).withColumn("score", F.round(F.col("prior") + F.col("s"), 6))
    w = Window.partitionBy(*key).orderBy(F.col("score").desc(), "label")
    return s.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*key, F.col("label").alias("predicted"), "score")
