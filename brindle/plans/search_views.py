"""Filters with reasons, feeds, graph joins, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.dedup import donors
from brindle.operators.filters import adjusted, and3, collapsed, reasons, weighted_rubric
from brindle.operators.ranking import held_out, stable_order, top_per_group
from brindle.plans.registry import query
from brindle.session import table


@query(
    "filter_with_reasons",
    """
SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT coalesce(p_size <= 30, false) THEN 'size' END, CASE WHEN NOT coalesce(p_retailprice < 1500, false) THEN 'price' END,
 CASE WHEN NOT coalesce(p_type LIKE '%STEEL%' OR p_type LIKE '%BRASS%', false) THEN 'type' END], lambda x: x IS NOT NULL), ',') AS reasons FROM part""",
)
def filter_with_reasons(spark: SparkSession, d: str) -> DataFrame:
    checks = {"size": F.col("p_size") <= 30, "price": F.col("p_retailprice") < 1500, "type": F.col("p_type").contains("STEEL") | F.col("p_type").contains("BRASS")}
    return table(spark, d, "part").select("p_partkey", F.array_join(reasons(checks), ",").alias("reasons"))


@query(
    "reason_histogram",
    """
WITH r AS (SELECT unnest(list_filter([CASE WHEN NOT (p_size <= 30) THEN 'size' END, CASE WHEN NOT (p_retailprice < 1500) THEN 'price' END], lambda x: x IS NOT NULL)) AS reason FROM part)
SELECT reason, count(*) AS n FROM r GROUP BY 1""",
)
def reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    checks = {"size": F.col("p_size") <= 30, "price": F.col("p_retailprice") < 1500}
    return table(spark, d, "part").select(F.explode(reasons(checks)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "three_valued_and",
    """SELECT l_returnflag, CASE WHEN v IS NULL THEN 'unknown' WHEN v THEN 'yes' ELSE 'no' END AS verdict, count(*) AS n
FROM (SELECT l_returnflag, (CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity > 10 END) AND (CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_tax < 0.05 END) AS v FROM lineitem) GROUP BY 1, 2""",
)
def three_valued_and(spark: SparkSession, d: str) -> DataFrame:
    a = F.when(F.col("l_returnflag") != "N", F.col("l_quantity") > 10)
    b = F.when(F.col("l_linestatus") != "O", F.col("l_tax") < 0.05)
    v = F.when(and3(a, b).isNull(), "unknown").when(and3(a, b), "yes").otherwise("no")
    return table(spark, d, "lineitem").groupBy("l_returnflag", v.alias("verdict")).agg(F.count("*").alias("n"))


@query(
    "feed_topk_collapsed",
    """
WITH x AS (SELECT d.doc_id, source, n_chars, coalesce(toxic, 0) AS toxic, md5(text) AS g FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id),
y AS (SELECT *, max(toxic) OVER (PARTITION BY g) AS hide, count(*) OVER (PARTITION BY g) AS copies, row_number() OVER (PARTITION BY g ORDER BY doc_id DESC) AS rn FROM x)
SELECT doc_id, source, n_chars, copies FROM y WHERE hide = 0 AND rn = 1 ORDER BY n_chars DESC, doc_id LIMIT 100""",
)
def feed_topk(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    x = table(spark, d, "documents").select("doc_id", "source", "n_chars", F.md5("text").alias("g")).join(lab, "doc_id", "left")
    return collapsed(x, "g", [F.col("doc_id").desc()], F.coalesce("toxic", F.lit(0)) == 1).orderBy(F.col("n_chars").desc(), "doc_id").limit(100).select("doc_id", "source", "n_chars", "copies")


@query(
    "unscored_anti_join",
    """SELECT d.source, count(*) AS unscored FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL GROUP BY 1""",
)
def unscored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("unscored"))


@query(
    "disjoint_coverage",
    """
SELECT count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS labelled, count(*) FILTER (WHERE l.doc_id IS NULL AND n_chars >= 2000) AS long_only, count(*) FILTER (WHERE l.doc_id IS NULL AND n_chars < 2000) AS neither
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""",
)
def disjoint_coverage(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels").select("doc_id").distinct().withColumn("has", F.lit(True))
    x = table(spark, d, "documents").select("doc_id", "n_chars").join(lab, "doc_id", "left")
    has, long = F.col("has").isNotNull(), F.col("n_chars") >= 2000
    return x.agg(F.count_if(has).alias("labelled"), F.count_if(~has & long).alias("long_only"), F.count_if(~has & ~long).alias("neither"))


@query(
    "two_hop_overlap",
    """
WITH a AS (SELECT DISTINCT s_suppkey AS project, l_partkey AS skill FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_nationkey = 6),
b AS (SELECT DISTINCT l_orderkey AS posting, l_partkey AS skill FROM lineitem WHERE l_returnflag = 'R')
SELECT project, posting, count(*) AS shared, array_to_string(list_sort(list(skill)), ',') AS skills FROM a JOIN b USING (skill) GROUP BY 1, 2""",
)
def two_hop(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    here = table(spark, d, "supplier").where("s_nationkey = 6").select(F.col("s_suppkey").alias("l_suppkey"))
    mine = li.join(here, "l_suppkey", "left_semi").select(F.col("l_suppkey").alias("project"), F.col("l_partkey").alias("skill")).distinct()
    need = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("posting"), F.col("l_partkey").alias("skill")).distinct()
    g = mine.join(need, "skill").groupBy("project", "posting").agg(F.count("*").alias("shared"), F.array_sort(F.collect_list("skill")).alias("s"))
    return g.select("project", "posting", "shared", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("skills"))


@query(
    "skill_gap_demand",
    """
SELECT l_partkey AS skill, count(*) FILTER (WHERE l_returnflag = 'R') AS required, count(*) FILTER (WHERE l_returnflag = 'A') AS preferred, count(*) AS named FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 10) GROUP BY 1""",
)
def skill_gap(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"))
    x = table(spark, d, "lineitem").select("l_partkey", "l_returnflag").join(have, "l_partkey", "left_anti")
    return x.groupBy(F.col("l_partkey").alias("skill")).agg(F.count_if(F.col("l_returnflag") == "R").alias("required"), F.count_if(F.col("l_returnflag") == "A").alias("preferred"), F.count("*").alias("named"))


@query(
    "relational_division_donor",
    """
WITH c AS (SELECT DISTINCT l_orderkey AS p, l_suppkey AS t FROM lineitem), need AS (SELECT p, count(*) AS n FROM c GROUP BY 1),
born AS (SELECT l_orderkey AS p, min(l_shipdate) AS age FROM lineitem GROUP BY 1),
m AS (SELECT a.p, b.p AS donor, count(*) AS have FROM c a JOIN c b ON a.t = b.t AND a.p <> b.p GROUP BY 1, 2),
q AS (SELECT m.p, donor, row_number() OVER (PARTITION BY m.p ORDER BY age, donor) AS rn FROM m JOIN need ON need.p = m.p AND n = have JOIN born ON born.p = donor)
SELECT p AS parent, donor FROM q WHERE rn = 1""",
)
def division_donor(spark: SparkSession, d: str) -> DataFrame:
    return donors(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate"), "l_orderkey", "l_suppkey", "l_shipdate")


@query(
    "rubric_scores",
    """
SELECT p_partkey, round((coalesce(least(5, greatest(1, p_size / 10.0::DOUBLE)) * 2, 0) + coalesce(CASE WHEN p_retailprice > 1000 THEN least(5, p_retailprice / 400) END * 1, 0))
 / nullif(2 + CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END, 0), 6) AS grade FROM part""",
)
def rubric_scores(spark: SparkSession, d: str) -> DataFrame:
    size = F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.col("p_size") / 10.0))
    price = F.when(F.col("p_retailprice") > 1000, F.least(F.lit(5.0), F.col("p_retailprice") / 400))
    return table(spark, d, "part").select("p_partkey", F.round(weighted_rubric({"size": (size, 2.0), "price": (price, 1.0)}), 6).alias("grade"))


@query(
    "personalised_scores",
    """
SELECT l_orderkey, round(max(greatest(0, least(1, l_quantity / 50.0::DOUBLE + greatest(-0.5::DOUBLE, least(0.5::DOUBLE, CASE l_returnflag WHEN 'R' THEN -0.3::DOUBLE WHEN 'A' THEN 0.2::DOUBLE ELSE 0 END + CASE l_linestatus WHEN 'O' THEN 0.4::DOUBLE ELSE -0.4::DOUBLE END))))), 6) AS score
FROM lineitem GROUP BY 1""",
)
def personalised(spark: SparkSession, d: str) -> DataFrame:
    w = F.when(F.col("l_returnflag") == "R", -0.3).when(F.col("l_returnflag") == "A", 0.2).otherwise(0.0) + F.when(F.col("l_linestatus") == "O", 0.4).otherwise(-0.4)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.max(adjusted(F.col("l_quantity") / 50.0, w)), 6).alias("score"))


@query(
    "stable_shuffle_holdout",
    """
SELECT doc_id, ('0x' || substr(sha256('v1:' || doc_id::VARCHAR), 1, 6))::BIGINT AS place, floor(('0x' || substr(sha256('v1:' || doc_id::VARCHAR), 1, 2))::BIGINT * 100 / 256.0) < 20 AS held_out FROM documents""",
)
def stable_shuffle(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select("doc_id", stable_order("v1", k).alias("place"), held_out("v1", 20, k).alias("held_out"))


@query(
    "tier_split_caps",
    """SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3""",
)
def tier_split(spark: SparkSession, d: str) -> DataFrame:
    return top_per_group(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 3).select("p_brand", "p_partkey")


@query(
    "search_contains",
    """SELECT doc_id, source, lang FROM documents WHERE text ILIKE '%license%' AND lang = 'en'""",
)
def search_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where((F.col("lang") == "en") & F.col("text").ilike("%license%")).select("doc_id", "source", "lang")
