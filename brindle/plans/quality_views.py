"""Ranking and classification metrics over labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import metrics
from brindle.plans.registry import query
from brindle.session import table

_S = """s AS (SELECT d.source, d.doc_id, round(least(n_chars / 2000.0::DOUBLE, 1), 6) AS score, l.quality AS label, l.toxic FROM documents d JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("label"), F.max("toxic").alias("toxic"))
    docs = table(spark, d, "documents").select("source", "doc_id", F.round(F.least(F.col("n_chars") / 2000.0, F.lit(1.0)), 6).alias("score"))
    return docs.join(lab, "doc_id")


@query(
    "ranking_metrics",
    f"""WITH {_S}, r AS (SELECT source AS query, label AS rel, row_number() OVER (PARTITION BY source ORDER BY score DESC, label, doc_id) AS rank, row_number() OVER (PARTITION BY source ORDER BY label DESC, doc_id) AS ideal FROM s),
h AS (SELECT *, sum((rel > 0)::INT) OVER (PARTITION BY query ORDER BY rank) AS hits FROM r),
g AS (SELECT query, sum(CASE WHEN rank <= 10 THEN (rel > 0)::INT ELSE 0 END) AS top, sum((rel > 0)::INT) AS relevant, sum(CASE WHEN rel > 0 THEN hits / rank::DOUBLE ELSE 0 END) AS precisions, min(CASE WHEN rel > 0 THEN rank END) AS first_hit,
 sum(CASE WHEN rank <= 10 THEN (power(2.0::DOUBLE, rel) - 1) / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 10 THEN (power(2.0::DOUBLE, rel) - 1) / log2(ideal + 1.0::DOUBLE) ELSE 0 END) AS idcg FROM h GROUP BY 1)
SELECT query, round(top / 10.0::DOUBLE, 6) AS p_at_k, round(coalesce(top / nullif(relevant, 0)::DOUBLE, 0), 6) AS recall_at_k, (top > 0)::INT::DOUBLE AS hit_at_k, round(coalesce(precisions / nullif(relevant, 0), 0), 6) AS ap,
 round(coalesce(1.0::DOUBLE / first_hit, 0), 6) AS rr, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg_at_k FROM g""",
)
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    judged = _scored(spark, d).select(F.col("source").alias("query"), F.col("doc_id").alias("key"), "score", F.col("label").alias("relevance"))
    out = metrics.ranking_metrics(judged)
    return out.select("query", *[F.round(c, 6).alias(c) for c in out.columns if c != "query"])


@query(
    "confusion",
    f"""WITH {_S}, c AS (SELECT sum((score >= 0.5 AND label = 1)::INT)::BIGINT AS tp, sum((score >= 0.5 AND label <> 1)::INT)::BIGINT AS fp, sum((score < 0.5 AND label = 1)::INT)::BIGINT AS fn, sum((score < 0.5 AND label <> 1)::INT)::BIGINT AS tn FROM s)
SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1,
 round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 0), 6) AS accuracy, round(coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0), 6) AS fpr, round(coalesce(fn / nullif(fn + tp, 0)::DOUBLE, 0), 6) AS fnr FROM c""",
)
def confusion(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.confusion(_scored(spark, d), 0.5)
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in out.columns[4:]])


@query("roc_auc", f"WITH {_S} SELECT round(sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS roc_auc FROM s a JOIN s b ON a.label = 1 AND b.label = 0")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(_scored(spark, d)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query(
    "pr_auc",
    f"""WITH {_S}, g AS (SELECT score, sum(label) AS pos, count(*) AS n FROM s GROUP BY 1), c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS n FROM g)
SELECT round(sum(pos * tp / n::DOUBLE) / sum(pos), 6) AS pr_auc FROM c""",
)
def pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pr_auc(_scored(spark, d)).select(F.round("pr_auc", 6).alias("pr_auc"))


@query(
    "calibration_ece_brier",
    f"""WITH {_S}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS conf, avg(label) AS acc, sum((score - label) * (score - label)) AS sq FROM s GROUP BY 1)
SELECT round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier FROM b""",
)
def calibration(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration(_scored(spark, d)).select(F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"))


@query(
    "kendall_tau",
    f"""WITH {_S}, p AS (SELECT a.source, sign(a.score - b.score) * sign(a.label - b.label) AS c, (a.score = b.score)::INT AS ta, (a.label = b.label)::INT AS tb FROM s a JOIN s b ON a.source = b.source AND a.doc_id <> b.doc_id)
SELECT source, round(sum(c) / nullif(sqrt((count(*) - sum(ta))::DOUBLE * (count(*) - sum(tb))::DOUBLE), 0), 6) AS kendall_tau FROM p GROUP BY 1""",
)
def kendall(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    more = s.groupBy("source").count().where("count > 1").select("source")
    return metrics.kendall_tau(s.join(more, "source"), ["source"], "score", "label").select("source", F.round("kendall_tau", 6).alias("kendall_tau"))


@query("paired_compare", f"WITH {_S} SELECT round(avg(label), 6) AS base_mean, round(avg(score), 6) AS other_mean, round(avg(score - label), 6) AS difference, sum((score < label)::INT)::BIGINT AS lost, sum((score > label)::INT)::BIGINT AS gained, count(*) AS n FROM s")
def paired(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.paired_compare(_scored(spark, d), "label", "score")
    return out.select(F.round("base_mean", 6).alias("base_mean"), F.round("other_mean", 6).alias("other_mean"), F.round("difference", 6).alias("difference"), "lost", "gained", "n")


@query(
    "calibration_p10_threshold",
    f"""WITH {_S}, k AS (SELECT list_sort(list(score) FILTER (WHERE label = 1)) AS kept, avg(score) FILTER (WHERE label = 1) AS kept_mean, avg(score) FILTER (WHERE label = 0) AS skipped_mean FROM s)
SELECT CASE WHEN len(kept) >= 10 THEN kept[len(kept) // 10 + 1] END AS threshold, round(kept_mean, 6) AS kept_mean, round(skipped_mean, 6) AS skipped_mean FROM k""",
)
def calibration_p10(spark: SparkSession, d: str) -> DataFrame:
    # the score of a given place comes from counts of distinct scores, so no list of all scores is gathered
    s = _scored(spark, d)
    kept = s.where("label = 1").groupBy("score").agg(F.count("*").alias("n"))
    upto = metrics.running_totals(kept, "score", ["n"]).withColumn("upto", F.col("before_n") + F.col("n"))
    upto = upto.crossJoin(F.broadcast(kept.agg(F.sum("n").alias("all"))))  # one row
    place = upto.agg(F.min(F.when((F.col("all") >= 10) & (F.col("upto") > F.floor(F.col("all") / 10)), F.col("score"))).alias("threshold"))
    means = s.agg(F.round(F.avg(F.when(F.col("label") == 1, F.col("score"))), 6).alias("kept_mean"), F.round(F.avg(F.when(F.col("label") == 0, F.col("score"))), 6).alias("skipped_mean"))
    return place.join(F.broadcast(means))  # one row each


_DRAWN = " + ".join(f"(u >= {t}::DOUBLE)::INT" for t in metrics.POISSON)


@query(
    "bootstrap_interval",
    f"""WITH {_S}, r AS (SELECT label::DOUBLE AS v, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT AS step, ('0x' || substr(md5('42:' || doc_id), 9, 8))::BIGINT AS start, unnest(range(200)) AS round FROM s WHERE label IS NOT NULL),
w AS (SELECT round, v, {_DRAWN} AS w FROM (SELECT round, v, ((start + step * (2 * round + 1)) % 4294967296)::DOUBLE / 4294967296.0::DOUBLE AS u FROM r)), m AS (SELECT sum(v * w) / sum(w) AS mean FROM w GROUP BY round)
SELECT round(quantile_cont(mean, 0.025::DOUBLE), 6) AS low, round(quantile_cont(mean, 0.975::DOUBLE), 6) AS high, round(avg(mean), 6) AS centre FROM m""",
)
def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.bootstrap_interval(_scored(spark, d), "doc_id", "label")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])
