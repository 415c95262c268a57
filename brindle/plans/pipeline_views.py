"""Funnels, cadence, shares and queue health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators.filters import shares
from brindle.operators.ranking import largest_remainder, top_per_group
from brindle.plans.registry import query
from brindle.session import table

NOW = "2001-09-01 00:00:00"
#: Score bands: closed on the left.
BANDS = (("0.00-0.50", 0.0, 0.5), ("0.50-0.65", 0.5, 0.65), ("0.65-0.80", 0.65, 0.8), ("0.80-1.00", 0.8, 1.01))


def band_of(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, low, high in reversed(BANDS):
        out = F.when((score >= low) & (score < high), name).otherwise(out)
    return out


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def _days(a: str, b: str) -> str:
    return f"greatest(floor((epoch({b}) - epoch({a})) / 86400), 0)::INT"


@query(
    "funnel_score_bands",
    """
WITH m AS (SELECT l_orderkey, max(least(l_quantity / 50.0::DOUBLE, 1.0::DOUBLE)) AS score FROM lineitem GROUP BY 1),
a AS (SELECT o_orderstatus, score FROM orders LEFT JOIN m ON o_orderkey = l_orderkey),
b AS (SELECT CASE WHEN score < 0.5 THEN '0.00-0.50' WHEN score < 0.65 THEN '0.50-0.65' WHEN score < 0.8 THEN '0.65-0.80' WHEN score < 1.01 THEN '0.80-1.00' END AS band, * FROM a)
SELECT band, count(*) AS total, sum((o_orderstatus <> 'P')::INT)::BIGINT AS answered, sum((o_orderstatus = 'F')::INT)::BIGINT AS engaged,
       round(sum((o_orderstatus = 'F')::INT)::DOUBLE / nullif(sum((o_orderstatus <> 'P')::INT), 0), 6) AS engaged_rate, count(*) >= 5 AS meaningful
FROM b GROUP BY 1""",
)
def funnel_score_bands(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.least(F.col("l_quantity") / 50.0, F.lit(1.0))).alias("score"))
    a = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(best, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    s = F.col("o_orderstatus")
    g = a.groupBy(band_of(F.col("score")).alias("band")).agg(F.count("*").alias("total"), _sum(s != "P").alias("answered"), _sum(s == "F").alias("engaged"))
    return g.withColumn("engaged_rate", F.round(F.try_divide(F.col("engaged"), F.col("answered")), 6)).withColumn("meaningful", F.col("total") >= 5)


@query(
    "stage_counts_null_safe_rates",
    """
WITH c AS (SELECT o_orderpriority AS stage_group, count(*) AS total, sum((o_orderstatus IN ('O', 'F'))::INT)::BIGINT AS submitted, sum((o_orderstatus = 'F')::INT)::BIGINT AS answered,
  sum((o_orderstatus = 'X')::INT)::BIGINT AS failed FROM orders GROUP BY 1)
SELECT *, round(answered::DOUBLE / nullif(submitted, 0), 6) AS answer_rate, round(answered::DOUBLE / nullif(failed, 0), 6) AS per_failed FROM c""",
)
def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stage_group")).agg(F.count("*").alias("total"), _sum(s.isin("O", "F")).alias("submitted"), _sum(s == "F").alias("answered"), _sum(s == "X").alias("failed"))
    return g.withColumn("answer_rate", F.round(F.try_divide(F.col("answered"), F.col("submitted")), 6)).withColumn("per_failed", F.round(F.try_divide(F.col("answered"), F.col("failed")), 6))


@query(
    "silence_report",
    f"""
SELECT o_orderkey, {_days('o_orderdate', f"TIMESTAMP '{NOW}'")} AS days_since, {_days('o_orderdate', f"TIMESTAMP '{NOW}'")} >= 365 AS stale,
  EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS has_follow_up
FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '{NOW}' - INTERVAL 14 DAY""",
)
def silence_report(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    o = table(spark, d, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") <= now - F.expr("INTERVAL 14 DAY")))
    open_task = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct().withColumn("has", F.lit(True))
    days = F.greatest(F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))) / 86400), F.lit(0)).cast("int")
    return o.join(open_task, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", days.alias("days_since"), (days >= 365).alias("stale"), F.coalesce("has", F.lit(False)).alias("has_follow_up"))


@query(
    "reply_latency",
    f"""
WITH f AS (SELECT l_orderkey, min(l_shipdate) AS first_at FROM lineitem GROUP BY 1),
r AS (SELECT o_orderpriority, {_days('o_orderdate', 'first_at')} AS days FROM orders JOIN f ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'O')
SELECT o_orderpriority, count(*) AS samples, median(days)::DOUBLE AS median_days, min(days) AS fastest, max(days) AS slowest,
  CASE WHEN count(*) >= 5 THEN round(median(days)::DOUBLE)::BIGINT + 7 END AS suggestion FROM r GROUP BY 1""",
)
def reply_latency(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("at"))
    r = table(spark, d, "orders").where("o_orderstatus <> 'O'").join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    days = F.greatest(F.floor((F.unix_timestamp(F.col("at").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))) / 86400), F.lit(0)).cast("int")
    g = r.select("o_orderpriority", days.alias("days")).groupBy("o_orderpriority").agg(F.count("*").alias("samples"), F.percentile("days", 0.5).alias("median_days"), F.min("days").alias("fastest"), F.max("days").alias("slowest"))
    return g.withColumn("suggestion", F.when(F.col("samples") >= 5, F.round("median_days").cast("long") + 7))


@query(
    "weekly_zero_filled",
    """
WITH e AS (SELECT date_trunc('week', ts)::DATE AS week, count(*) AS n FROM events GROUP BY 1),
m AS (SELECT max(date_trunc('week', ts))::DATE AS last FROM events),
w AS (SELECT (last - (7 * i)::INT)::DATE AS week FROM m, range(12) t(i))
SELECT strftime(w.week, '%Y-%m-%d') AS week, coalesce(n, 0)::BIGINT AS n, (SELECT coalesce(sum(n), 0)::BIGINT FROM e, m WHERE e.week < last - 77) AS older FROM w LEFT JOIN e ON e.week = w.week""",
)
def weekly_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.count("*").alias("n"))
    last = e.agg(F.max("week").alias("last"))
    weeks = last.select("last", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")).select("last", F.date_sub("last", F.col("i") * 7).alias("week"))
    older = e.join(F.broadcast(last)).where(F.col("week") < F.date_sub("last", 77)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("older"))  # one row each
    return weeks.join(e, "week", "left").join(F.broadcast(older)).select(F.date_format("week", "yyyy-MM-dd").alias("week"), F.coalesce("n", F.lit(0)).alias("n"), "older")


@query(
    "status_histogram_full_enum",
    """SELECT s.status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X'), ('Y')) s(status) LEFT JOIN orders ON o_orderstatus = s.status GROUP BY 1""",
)
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    every = spark.createDataFrame([(x,) for x in "FOPXY"], "status string")
    n = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("c"))
    return every.join(n, F.col("status") == F.col("o_orderstatus"), "left").select("status", F.coalesce("c", F.lit(0)).alias("n"))


@query(
    "kind_stats_percentiles",
    """
SELECT event_type AS kind, count(*) AS total, count(*) FILTER (WHERE value > 50) AS slow, count(DISTINCT user_id) AS workers, count(DISTINCT coalesce(json_extract_string(props, '$.k'), 'none')) AS owners,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS low, max(value) AS high FROM events GROUP BY 1""",
)
def kind_stats(spark: SparkSession, d: str) -> DataFrame:
    owner = F.coalesce(F.get_json_object("props", "$.k"), F.lit("none"))
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(
        F.count("*").alias("total"), F.count_if(F.col("value") > 50).alias("slow"), F.count_distinct("user_id").alias("workers"), F.count_distinct(owner).alias("owners"),
        F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.min("value").alias("low"), F.max("value").alias("high"),
    )


@query(
    "latest_error_per_kind",
    """SELECT event_type, event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE value > 90) WHERE rn = 1""",
)
def latest_error(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value > 90")
    return e.groupBy("event_type").agg(F.max(F.struct("ts", "event_id", "user_id", "value")).alias("x")).select("event_type", "x.event_id", "x.user_id", "x.value")


@query(
    "backlog_progress_eta",
    """
WITH l AS (SELECT max(ts) AS now FROM events),
c AS (SELECT event_type, count(*) FILTER (WHERE value >= 30) AS waiting, count(*) FILTER (WHERE value < 30) AS done, count(*) FILTER (WHERE value < 30 AND ts > now - INTERVAL 1 DAY) AS recent FROM events, l GROUP BY 1)
SELECT *, round(recent / 1440.0::DOUBLE, 6) AS per_minute, CASE WHEN recent > 0 THEN ceil(waiting * 1440 / recent::DOUBLE)::BIGINT END AS eta_minutes FROM c""",
)
def backlog(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    done = F.col("value") < 30
    c = e.join(F.broadcast(now)).groupBy("event_type").agg(F.count_if(~done).alias("waiting"), F.count_if(done).alias("done"), F.count_if(done & (F.col("ts") > F.col("now") - F.expr("INTERVAL 1 DAY"))).alias("recent"))  # now is one row
    return c.withColumn("per_minute", F.round(F.col("recent") / 1440.0, 6)).withColumn("eta_minutes", F.when(F.col("recent") > 0, F.ceil(F.col("waiting") * 1440 / F.col("recent")).cast("long")))


@query(
    "share_topn_other",
    """
WITH b AS (SELECT p_brand, count(*) AS total, sum((l_returnflag = 'R')::INT) AS matching FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1),
r AS (SELECT *, CASE WHEN p_brand IS NULL THEN 'unclassified' WHEN row_number() OVER (ORDER BY p_brand IS NULL, total DESC, p_brand) <= 5 THEN p_brand ELSE 'other' END AS name FROM b)
SELECT name, sum(total)::BIGINT AS total, sum(matching)::BIGINT AS matching, round(sum(matching)::DOUBLE / nullif(sum(total), 0), 6) AS share FROM r GROUP BY 1""",
)
def share_topn(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    li = table(spark, d, "lineitem").select("l_partkey", "l_returnflag").join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    return shares(li, "p_brand", F.col("l_returnflag") == "R", 5).withColumn("share", F.round("share", 6))


@query(
    "lateral_latest_per_parent",
    """SELECT c_custkey, o_orderkey, o_orderstatus FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F', o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) ON o_custkey = c_custkey AND rn = 1""",
)
def latest_per_parent(spark: SparkSession, d: str) -> DataFrame:
    best = top_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], [F.col("o_orderstatus") == "F", F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return table(spark, d, "customer").select("c_custkey").join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_orderstatus")


@query(
    "due_nulls_first_topk",
    """
WITH l AS (SELECT l_suppkey, max(l_shipdate) AS last FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT s_suppkey, s_name, strftime(last, '%Y-%m-%d') AS last FROM supplier LEFT JOIN l ON l_suppkey = s_suppkey ORDER BY last NULLS FIRST, s_suppkey LIMIT 25""",
)
def due_topk(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "lineitem").where("l_quantity > 45").groupBy("l_suppkey").agg(F.max("l_shipdate").alias("at"))
    s = table(spark, d, "supplier").join(last, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return s.orderBy(F.date_format("at", "yyyy-MM-dd").asc_nulls_first(), "s_suppkey").limit(25).select("s_suppkey", "s_name", F.date_format("at", "yyyy-MM-dd").alias("last"))


@query(
    "open_count_per_parent",
    """SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0) AS open_count FROM nation""",
)
def open_count(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal > 0").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    return table(spark, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("c", F.lit(0)).alias("open_count"))


@query(
    "quota_largest_remainder",
    """
WITH s AS (SELECT o_orderpriority AS stream, count(*)::DOUBLE AS weight FROM orders GROUP BY 1),
e AS (SELECT stream, 37 * weight / sum(weight) OVER () AS x FROM s),
f AS (SELECT stream, floor(x) AS w, x - floor(x) AS r, 37 - sum(floor(x)) OVER () AS left_over FROM e)
SELECT stream, (w + (row_number() OVER (ORDER BY r DESC, stream) <= left_over)::INT)::BIGINT AS quota FROM f""",
)
def quota(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stream")).agg(F.count("*").cast("double").alias("weight"))
    return largest_remainder(s, 37)


@query(
    "digest_trailing_window",
    """
WITH l AS (SELECT max(o_orderdate) AS now FROM orders)
SELECT count(*) FILTER (WHERE o_orderdate > now - INTERVAL 7 DAY) AS new_orders, count(*) FILTER (WHERE o_orderdate > now - INTERVAL 7 DAY AND o_orderstatus = 'F') AS answered,
 count(DISTINCT o_custkey) FILTER (WHERE o_orderdate > now - INTERVAL 30 DAY) AS active, round(max(o_totalprice) FILTER (WHERE o_orderdate > now - INTERVAL 7 DAY), 2) AS best FROM orders, l""",
)
def digest(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    x = o.join(F.broadcast(o.agg(F.max("o_orderdate").alias("now"))))  # now is one row
    week, month = F.col("o_orderdate") > F.col("now") - F.expr("INTERVAL 7 DAY"), F.col("o_orderdate") > F.col("now") - F.expr("INTERVAL 30 DAY")
    return x.agg(F.count_if(week).alias("new_orders"), F.count_if(week & (F.col("o_orderstatus") == "F")).alias("answered"), F.count_distinct(F.when(month, F.col("o_custkey"))).alias("active"), F.round(F.max(F.when(week, F.col("o_totalprice"))), 2).alias("best"))


@query(
    "decision_patterns",
    """SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2 HAVING count(*) >= 3 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""",
)
def decision_patterns(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "supplier").where("s_acctbal < 0").select("s_suppkey")
    g = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n")).where("n >= 3")
    return g.join(known, F.col("l_suppkey") == F.col("s_suppkey"), "left_anti")


@query(
    "call_audit_rollup",
    """SELECT event_type AS provider, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, round(sum(value), 2) AS spent, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""",
)
def call_audit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("provider"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("spent"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    "position_of_n",
    """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations""",
)
def position_of_n(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id")
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w.orderBy("turn", "role", "text")).cast("long").alias("pos"), F.count("*").over(w).alias("n"))
