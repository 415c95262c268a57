"""Bookkeeping over runs, boards, queues and links: folds, merges, schedules, budgets and liveness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.text import squeezed
from brindle.operators.tracking import best_link, board_keepers, budgeted, full_outer_diff, merged_survivors, next_due
from brindle.plans.registry import query
from brindle.session import table

NOW = "2001-08-01 00:00:00"


@query(
    "crawl_run_fold",
    """SELECT user_id AS run, count(*) AS reported, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 4) AS total, count(*) >= 8 AS closed FROM events GROUP BY 1""",
)
def crawl_run_fold(spark: SparkSession, d: str) -> DataFrame:
    """Results add up into their run; a run closes when as many have reported as it expects (8)."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("run"))
    return e.agg(F.count("*").alias("reported"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.sum("value"), 4).alias("total"), (F.count("*") >= 8).alias("closed"))


@query(
    "freshest_loser_merge",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate, CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS closed,
 row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_quantity) AS old, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_quantity DESC) AS young FROM lineitem)
SELECT l_orderkey, l_linenumber, max(l_partkey) FILTER (old = 1) AS kept_part, max(l_quantity) FILTER (young = 1) AS newest_quantity, epoch(min(closed))::BIGINT AS closed_at, count(*) AS copies FROM r GROUP BY 1, 2""",
)
def freshest_loser_merge(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("closed", F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")))
    m = merged_survivors(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_quantity"], "closed")
    return m.select("l_orderkey", "l_linenumber", F.col("kept.l_partkey").alias("kept_part"), F.col("newest.l_quantity").alias("newest_quantity"), F.unix_timestamp(F.col("closed_at").cast("timestamp")).alias("closed_at"), "copies")


@query(
    "board_merge",
    """WITH b AS (SELECT c_custkey, c_nationkey, c_mktsegment, first_value(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS keeper FROM customer)
SELECT keeper, count(DISTINCT b.c_custkey) AS boards, count(o_orderkey) AS moved FROM b LEFT JOIN orders ON o_custkey = b.c_custkey AND b.c_custkey <> keeper GROUP BY 1""",
)
def board_merge(spark: SparkSession, d: str) -> DataFrame:
    """One keeper for each (nation, segment); orders of the absorbed ones are counted as moved."""
    keep = board_keepers(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey", F.col("c_acctbal"))
    moved = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    k = keep.join(moved, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("c_custkey") != F.col("keeper")), "left")
    return k.groupBy("keeper").agg(F.count("*").alias("boards"), F.sum(F.coalesce("n", F.lit(0))).alias("moved"))


@query(
    "poll_schedule",
    """WITH r AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events),
g AS (SELECT user_id, max(ts) AS last_at, coalesce(min(back) FILTER (NOT bad) - 1, count(*)) AS failures FROM r GROUP BY 1)
SELECT user_id, failures::BIGINT AS failures, (epoch_us(last_at) // 1000000 + least(3600 * pow(2, failures)::BIGINT, 86400)) AS next_due FROM g""",
)
def poll_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Next poll of each source: its interval, doubled for every failure since the last success, a day at most."""
    return next_due(table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("bad")), "user_id", 3600, 86400)


@query(
    "budget_refusals",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, n, sec AS opened, 1 AS used, true AS ok FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.n, CASE WHEN e.sec - opened >= 86400 THEN e.sec ELSE opened END, CASE WHEN e.sec - opened >= 86400 THEN 1 WHEN used < 2 THEN used + 1 ELSE used END, e.sec - opened >= 86400 OR used < 2 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, count(*) AS requests, count(*) FILTER (NOT ok) AS refused FROM w GROUP BY 1""",
)
def budget_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Two requests a day and user, the day opening at its first request; refused requests use nothing up."""
    b = budgeted(table(spark, d, "events"), 86400.0, 2)
    return b.groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(~F.col("allowed")).alias("refused"))


@query("due_reminders", f"SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '{NOW}' - INTERVAL 200 DAY AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def due_reminders(spark: SparkSession, d: str) -> DataFrame:
    """Due, still open and not rung before."""
    due = table(spark, d, "orders").where((F.col("o_orderstatus") != "F") & (F.col("o_orderdate").cast("timestamp") <= F.expr(f"timestamp'{NOW}' - interval 200 days")))
    rung = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return due.select("o_orderkey").join(rung, "o_orderkey", "left_anti")


@query("heartbeats", "WITH n AS (SELECT max(ts) AS now FROM events) SELECT user_id, epoch_us(max(ts)) // 1000000 AS last_seen, any_value(now) - max(ts) > INTERVAL 2 DAY AS dead FROM events, n GROUP BY 1")
def heartbeats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    seen, now = e.groupBy("user_id").agg(F.max("ts").alias("last")), e.agg(F.max("ts").alias("now"))
    return seen.crossJoin(F.broadcast(now)).select("user_id", F.unix_timestamp("last").alias("last_seen"), (F.col("last") < F.col("now") - F.expr("interval 2 days")).alias("dead"))  # now is one row


@query("crawl_meter", "SELECT event_type AS host, count(*) AS requests, round(sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END), 4) AS waited, count(*) FILTER (user_id % 2 = 1) AS network FROM events GROUP BY 1")
def crawl_meter(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("user_id") % 2 == 0
    return table(spark, d, "events").groupBy(F.col("event_type").alias("host")).agg(F.count("*").alias("requests"), F.round(F.sum(F.when(even, F.col("value")).otherwise(0)), 4).alias("waited"), F.count_if(~even).alias("network"))


@query("mail_checkpoints", "WITH m AS (SELECT conv_id % 3 AS box, max(conv_id) AS validity FROM conversations GROUP BY 1) SELECT box, validity, max(turn) FILTER (conv_id = validity) AS last_uid, count(*) FILTER (conv_id <> validity) AS stale FROM conversations JOIN m ON conv_id % 3 = box GROUP BY 1, 2")
def mail_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """The newest validity of each box and the largest uid under it; mail of an older validity is read anew."""
    c = table(spark, d, "conversations").select((F.col("conv_id") % 3).alias("box"), "conv_id", "turn")
    per = c.groupBy("box", "conv_id").agg(F.max("turn").alias("uid"), F.count("*").alias("n"))
    top = per.groupBy("box").agg(F.max(F.struct("conv_id", "uid", "n")).alias("t"), F.sum("n").alias("all"))
    return top.select("box", F.col("t.conv_id").alias("validity"), F.col("t.uid").alias("last_uid"), (F.col("all") - F.col("t.n")).alias("stale"))


@query(
    "registry_diff",
    """WITH a AS (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_regionkey <> 3), b AS (SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN n_name || '!' ELSE n_name END AS v FROM nation WHERE n_regionkey <> 0)
SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'retired' WHEN a.k IS NULL THEN 'added' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' ELSE 'kept' END AS state FROM a FULL OUTER JOIN b ON a.k = b.k""",
)
def registry_diff(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    old = n.where("n_regionkey <> 3").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    new = n.where("n_regionkey <> 0").select(F.col("n_nationkey").alias("key"), F.when(F.col("n_regionkey") == 1, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name")).alias("value"))
    return full_outer_diff(old, new)


@query("submission_ledger", "SELECT o_custkey, o_orderpriority, count(*) AS attempts, min(o_orderkey) AS first_attempt FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def submission_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Keys with more than one attempt, and the attempt that stands."""
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("attempts"), F.min("o_orderkey").alias("first_attempt")).where("attempts > 1")


@query(
    "link_refresh",
    """WITH old AS (SELECT DISTINCT l_orderkey AS posting, l_suppkey AS skill, l_linestatus = 'F' AS locked FROM lineitem WHERE l_quantity < 25), new AS (SELECT DISTINCT l_orderkey AS posting, l_suppkey AS skill FROM lineitem WHERE l_quantity >= 20),
held AS (SELECT posting FROM old GROUP BY 1 HAVING bool_or(locked))
SELECT posting, skill, 'kept' AS origin FROM (SELECT DISTINCT posting, skill FROM old) WHERE posting IN (SELECT posting FROM held) UNION ALL SELECT posting, skill, 'new' FROM new WHERE posting NOT IN (SELECT posting FROM held)""",
)
def link_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Links are replaced whole, but for postings that hold a locked one."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("posting"), F.col("l_suppkey").alias("skill"), "l_quantity", "l_linestatus")
    old, new = li.where("l_quantity < 25"), li.where("l_quantity >= 20").select("posting", "skill").distinct()
    held = old.where("l_linestatus = 'F'").select("posting").distinct()
    kept = old.select("posting", "skill").distinct().join(held, "posting", "left_semi").withColumn("origin", F.lit("kept"))
    return kept.unionByName(new.join(held, "posting", "left_anti").withColumn("origin", F.lit("new")))


_NORM = r"md5(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0B]+', ' ', 'g')))"


@query(
    "chunk_carry_over",
    f"WITH o AS (SELECT doc_id, source, {_NORM} AS d FROM documents WHERE lang <> 'de'), n AS (SELECT doc_id, source, {_NORM} AS d FROM documents WHERE lang = 'de' OR n_chars % 2 = 0), c AS (SELECT source, d, min(doc_id) AS donor FROM o GROUP BY 1, 2) SELECT n.doc_id, c.donor FROM n LEFT JOIN c ON n.source = c.source AND n.d = c.d",
)
def chunk_carry_over(spark: SparkSession, d: str) -> DataFrame:
    """A new text that an old one of the same source equals, but for blanks, takes over its chunks; others have none yet."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", F.md5(squeezed(F.col("text"))).alias("d"))
    old = docs.where("lang <> 'de'").groupBy("source", "d").agg(F.min("doc_id").alias("donor"))
    return docs.where("lang = 'de' or n_chars % 2 = 0").join(old, ["source", "d"], "left").select("doc_id", "donor")


_CHUNK = "c AS (SELECT doc_id, md5(substr(text, (375 * i + 1)::BIGINT, 500)) AS d FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 500 THEN 1 ELSE ((length(text) - 500 + 374) // 375 + 1) END)) AS i FROM documents WHERE length(text) > 0))"


@query("encode_once", f"WITH {_CHUNK}, f AS (SELECT d, min(doc_id) AS first_doc FROM c GROUP BY 1) SELECT doc_id, count(*) AS chunks, count(*) FILTER (first_doc = doc_id) AS own FROM c JOIN f USING (d) GROUP BY 1")
def encode_once(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each document, and how many are first met there: equal chunk texts would be encoded once. Digests travel, not texts."""
    n = F.length("text")
    last = F.when(n <= 500, 0).otherwise(F.ceil((n - 500) / 375)).cast("int")
    c = table(spark, d, "documents").where(n > 0).select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.md5(F.substring("text", i * 375 + 1, F.lit(500))))).alias("d"))
    per = c.groupBy("d", "doc_id").agg(F.count("*").alias("n"))
    first = per.groupBy("d").agg(F.min("doc_id").alias("first_doc"))
    return per.join(first, "d").groupBy("doc_id").agg(F.sum("n").alias("chunks"), F.sum(F.when(F.col("first_doc") == F.col("doc_id"), F.col("n")).otherwise(0)).alias("own"))


@query("split_locks", f"WITH x AS (SELECT doc_id, source, {_NORM} AS d, n_chars % 10 = 0 AS locked FROM documents) SELECT doc_id, CASE WHEN locked THEN doc_id ELSE min(doc_id) FILTER (NOT locked) OVER (PARTITION BY source, d) END AS listing FROM x")
def split_locks(spark: SparkSession, d: str) -> DataFrame:
    """Listings of equal texts; a posting taken out by hand stays alone for good."""
    x = table(spark, d, "documents").select("doc_id", "source", F.md5(squeezed(F.col("text"))).alias("d"), (F.col("n_chars") % 10 == 0).alias("locked"))
    least = x.where("not locked").groupBy("source", "d").agg(F.min("doc_id").alias("least"))
    return x.join(least, ["source", "d"], "left").select("doc_id", F.when(F.col("locked"), F.col("doc_id")).otherwise(F.col("least")).alias("listing"))


@query("fetchable", "SELECT count(*) FILTER (c_acctbal > 0 AND c_name <> '' AND c_mktsegment IS NOT NULL) AS fetchable, count(*) FILTER (c_acctbal <= 0) AS unverified FROM customer")
def fetchable(spark: SparkSession, d: str) -> DataFrame:
    verified = F.col("c_acctbal") > 0
    return table(spark, d, "customer").agg(F.count_if(verified & (F.col("c_name") != "") & F.col("c_mktsegment").isNotNull()).alias("fetchable"), F.count_if(~verified).alias("unverified"))


@query("open_current_space", f"SELECT o_orderstatus <> 'F' AS is_open, o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 730 DAY AS current, o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS in_space, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def open_current_space(spark: SparkSession, d: str) -> DataFrame:
    """The three predicates that searches share."""
    is_open, current = F.col("o_orderstatus") != "F", F.col("o_orderdate").cast("timestamp") >= F.expr(f"timestamp'{NOW}' - interval 730 days")
    return table(spark, d, "orders").groupBy(is_open.alias("is_open"), current.alias("current"), F.col("o_orderpriority").rlike("^[12]").alias("in_space")).agg(F.count("*").alias("n"))


@query(
    "fuzzy_links",
    """WITH m AS (SELECT o_orderkey AS mail, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT o_orderkey AS application, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'),
s AS (SELECT mail, application, round(0.3::DOUBLE + CASE WHEN m.o_orderpriority = a.o_orderpriority THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN abs(epoch(m.o_orderdate) - epoch(a.o_orderdate)) <= 86400 * 200 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN abs(m.o_totalprice - a.o_totalprice) <= 0.1::DOUBLE * a.o_totalprice THEN 0.15::DOUBLE ELSE 0 END, 4) AS score FROM m JOIN a USING (o_custkey)),
r AS (SELECT *, row_number() OVER (PARTITION BY mail ORDER BY score DESC, application) AS rn, lead(score) OVER (PARTITION BY mail ORDER BY score DESC, application) AS second FROM s)
SELECT mail, application, score FROM r WHERE rn = 1 AND score >= 0.6 AND score - coalesce(second, 0) >= 0.15""",
)
def fuzzy_links(spark: SparkSession, d: str) -> DataFrame:
    """Mail is linked to the one application of its sender that the evidence favours clearly: a least score and a margin over the runner-up."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("at"), "o_orderpriority", "o_orderstatus")
    m = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("mail"), "o_custkey", F.col("o_totalprice").alias("mp"), F.col("at").alias("ma"), F.col("o_orderpriority").alias("mo"))
    a = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("application"), "o_custkey", "o_totalprice", "at", "o_orderpriority")
    points = lambda c, x: F.when(c, x).otherwise(0.0)
    score = F.lit(0.3) + points(F.col("mo") == F.col("o_orderpriority"), 0.3) + points(F.abs(F.col("ma") - F.col("at")) <= 86400 * 200, 0.25) + points(F.abs(F.col("mp") - F.col("o_totalprice")) <= F.col("o_totalprice") * 0.1, 0.15)
    s = m.join(a, "o_custkey").select("mail", "application", F.round(score, 4).alias("score"))
    return best_link(s, "mail", "application", 0.6, 0.15)


@query(
    "uncertain_sample",
    """WITH s AS (SELECT p_partkey, p_brand, p_retailprice AS x FROM part), r AS (SELECT p_brand, (min(x) + max(x)) / 2 AS mid FROM s GROUP BY 1)
SELECT p_brand, p_partkey, rn AS place FROM (SELECT s.p_brand, p_partkey, row_number() OVER (PARTITION BY s.p_brand ORDER BY round(abs(x - mid), 6), p_partkey) AS rn FROM s JOIN r USING (p_brand)) WHERE rn <= 5""",
)
def uncertain_sample(spark: SparkSession, d: str) -> DataFrame:
    """The rows of each group nearest to the middle of its observed scores."""
    s = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("x"))
    r = s.groupBy("p_brand").agg(((F.min("x") + F.max("x")) / 2).alias("mid"))
    w = Window.partitionBy("p_brand").orderBy(F.round(F.abs(F.col("x") - F.col("mid")), 6), "p_partkey")
    return s.join(r, "p_brand").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("p_brand", "p_partkey", "place")
