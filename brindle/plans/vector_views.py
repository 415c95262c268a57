"""Exact and quantised vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.metrics import spearman
from brindle.operators.vectors import best_per_group, bounded_topk, cosine_topk, recall_at_k, shortlist_size, signbit_shortlist, two_stage_topk
from brindle.plans.registry import query
from brindle.session import table

#: Every row whose id is divisible by this asks, against all rows.
EVERY, K = 50, 10
_SHORT = f"(SELECT greatest({4 * K}, ceil(3.2::DOUBLE * pow(count(*), 2.0::DOUBLE / 3))) FROM embeddings)"
_PAIRS = f"p AS (SELECT a.vec_id AS query, b.vec_id AS id, a.label AS la, b.label AS lb, a.embedding AS ea, b.embedding AS eb FROM embeddings a JOIN embeddings b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id)"
_SCORE = "round(greatest(0, least(1, list_cosine_similarity(ea::DOUBLE[], eb::DOUBLE[]))), 6)"
_TOP = f"SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT query, id, la, lb, {_SCORE} AS score FROM p)"
_HAMMING = "list_sum(list_transform(list_zip(ea, eb), lambda z: ((z[1] > 0) <> (z[2] > 0))::INT))"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query"), "embedding", "label"), e.select(F.col("vec_id").alias("id"), "embedding", "label")


@query("cosine_topk", f"WITH {_PAIRS} SELECT query, id, score, rank FROM ({_TOP}) WHERE rank <= {K}")
def topk(spark: SparkSession, d: str) -> DataFrame:
    return cosine_topk(*_sides(spark, d), K).withColumn("rank", F.col("rank").cast("long"))


@query("cosine_topk_filtered", f"WITH {_PAIRS} SELECT query, id, score, rank FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM ({_TOP}) WHERE la = lb) WHERE rank <= {K}")
def topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return cosine_topk(*_sides(spark, d), K, tag="label").withColumn("rank", F.col("rank").cast("long"))


@query("signbit_shortlist", f"WITH {_PAIRS} SELECT query, id, distance::INT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rn FROM (SELECT query, id, {_HAMMING} AS distance FROM p)) WHERE rn <= {_SHORT}")
def shortlist(spark: SparkSession, d: str) -> DataFrame:
    q, v = _sides(spark, d)
    return signbit_shortlist(q, v, shortlist_size(v.count(), K))


_STAGED = f"h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rn FROM (SELECT *, {_HAMMING} AS distance FROM p)) WHERE rn <= {_SHORT}), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT query, id, {_SCORE} AS score FROM h))"


@query("two_stage_topk", f"WITH {_PAIRS}, {_STAGED} SELECT query, id, score, rank FROM t WHERE rank <= {K}")
def staged(spark: SparkSession, d: str) -> DataFrame:
    return two_stage_topk(*_sides(spark, d), K).withColumn("rank", F.col("rank").cast("long"))


@query("bounded_topk", f"WITH {_PAIRS} SELECT query, id, score, rank FROM ({_TOP}) WHERE rank <= {K}")
def bounded(spark: SparkSession, d: str) -> DataFrame:
    return bounded_topk(*_sides(spark, d), K).withColumn("rank", F.col("rank").cast("long"))


@query("signbit_recall10", f"WITH {_PAIRS}, {_STAGED}, e AS (SELECT query, id FROM ({_TOP}) WHERE rank <= {K}) SELECT round(count(t.id)::DOUBLE / count(*), 6) AS recall FROM e LEFT JOIN (SELECT * FROM t WHERE rank <= {K}) t ON e.query = t.query AND e.id = t.id")
def recall10(spark: SparkSession, d: str) -> DataFrame:
    q, v = _sides(spark, d)
    return recall_at_k(two_stage_topk(q, v, K), cosine_topk(q, v, K)).select(F.round("recall", 6).alias("recall"))


@query("best_chunk_per_doc", f"WITH {_PAIRS} SELECT query, lb::BIGINT AS label, id, score FROM (SELECT query, lb, id, score, row_number() OVER (PARTITION BY query, lb ORDER BY score DESC, id) AS rn FROM ({_TOP})) WHERE rn = 1")
def best_chunk(spark: SparkSession, d: str) -> DataFrame:
    q, v = _sides(spark, d)
    return best_per_group(q, v.withColumn("label", F.col("label").cast("long")), "label")


@query(
    "rank_agreement_spearman",
    """WITH r AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY embedding[1]) + (count(*) OVER (PARTITION BY label, embedding[1]) - 1) / 2.0::DOUBLE AS ra,
 rank() OVER (PARTITION BY label ORDER BY embedding[2]) + (count(*) OVER (PARTITION BY label, embedding[2]) - 1) / 2.0::DOUBLE AS rb FROM embeddings)
SELECT label, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM r GROUP BY 1""",
)
def rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))
    return spearman(e, ["label"], "a", "b").select("label", F.round("spearman", 6).alias("spearman"), "n")
