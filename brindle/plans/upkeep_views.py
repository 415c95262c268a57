"""Two snapshots carved from orders: upserts, versions, closing, retention and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import incremental
from brindle.operators.dedup import survivors
from brindle.plans.registry import query
from brindle.session import table

AT = "2001-09-01 00:00:00"
_STORED = "old AS (SELECT o_orderkey, o_orderstatus AS hash, o_custkey FROM orders WHERE o_orderkey % 10 < 7)"
_SEEN = "seen AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS hash, o_custkey FROM orders WHERE o_orderkey % 10 >= 3)"
_CHANGE = "ch AS (SELECT coalesce(old.o_orderkey, seen.o_orderkey) AS o_orderkey, coalesce(seen.hash, old.hash) AS hash, CASE WHEN seen.o_orderkey IS NULL THEN 'absent' WHEN old.o_orderkey IS NULL THEN 'new' WHEN old.hash = seen.hash THEN 'same' ELSE 'changed' END AS change FROM old FULL JOIN seen ON old.o_orderkey = seen.o_orderkey)"


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("hash"), "o_custkey")
    then, at = F.lit("2001-08-01 00:00:00").cast("timestamp_ntz"), F.lit(AT).cast("timestamp_ntz")
    stored = o.where("o_orderkey % 10 < 7").select("*", then.alias("first_seen_at"), then.alias("last_seen_at"), F.lit(None).cast("timestamp_ntz").alias("closed_at"))
    seen = o.where("o_orderkey % 10 >= 3").withColumn("hash", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("hash")))
    return incremental.upsert(stored, seen, ["o_orderkey"], "hash", at)


@query("snapshot_upsert", f"WITH {_STORED}, {_SEEN}, {_CHANGE} SELECT o_orderkey, hash, change, CASE WHEN change = 'absent' THEN '2001-08-01' ELSE '2001-09-01' END AS last_seen, CASE WHEN change = 'new' THEN '2001-09-01' ELSE '2001-08-01' END AS first_seen FROM ch")
def snapshot_upsert(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return _snapshots(spark, d).select("o_orderkey", "hash", "change", day("last_seen_at").alias("last_seen"), day("first_seen_at").alias("first_seen"))


@query(
    "close_missing",
    f"""WITH {_STORED}, {_SEEN}, {_CHANGE}, g AS (SELECT *, o_orderkey % 8 AS board, max((change <> 'absent')::INT) OVER (PARTITION BY o_orderkey % 8) AS any_seen FROM ch)
SELECT board, sum((change = 'absent' AND any_seen = 1)::INT)::BIGINT AS closed, sum((change = 'absent' AND any_seen = 0)::INT)::BIGINT AS suspect FROM g GROUP BY 1""",
)
def close_missing(spark: SparkSession, d: str) -> DataFrame:
    t = _snapshots(spark, d).withColumn("board", F.col("o_orderkey") % 8)
    out = incremental.close_missing(t, "board", F.lit(AT).cast("timestamp_ntz"))
    return out.groupBy("board").agg(F.count_if(F.col("closed_at").isNotNull()).alias("closed"), F.count_if("suspect").alias("suspect"))


@query("versions_appended", f"WITH {_STORED}, {_SEEN}, {_CHANGE} SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND change = 'changed' THEN 2 ELSE 1 END AS version, hash FROM ch WHERE change IN ('new', 'changed')")
def versions_appended(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "orders").where("o_orderkey % 10 < 7 and o_orderkey % 3 = 0").select("o_orderkey", F.lit(1).alias("version"))
    return incremental.new_versions(_snapshots(spark, d), have, ["o_orderkey"], ["hash"])


@query("retention_keep", "SELECT o_orderkey, o_orderdate >= TIMESTAMP '2001-09-01' - INTERVAL 400 DAY OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) AS keep FROM orders")
def retention_keep(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.lit(None).cast("timestamp_ntz").alias("closed_at"), F.col("o_orderdate").alias("last_seen_at"))
    owned = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return incremental.retained(o, F.lit(AT).cast("timestamp_ntz"), 400, owned, ["o_orderkey"]).select("o_orderkey", "keep")


@query(
    "insert_once",
    "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1",
)
def insert_once(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return incremental.inserted_once(have, table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")])


@query(
    "illegal_transitions",
    """WITH s AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events)
SELECT from_state, to_state, count(*) AS n FROM s WHERE from_state IS NOT NULL AND from_state || '>' || to_state NOT IN ('signup>view', 'view>click', 'view>view', 'click>purchase', 'click>view', 'purchase>view') GROUP BY 1, 2""",
)
def illegal_transitions(spark: SparkSession, d: str) -> DataFrame:
    allowed = {"signup": ("view",), "view": ("click", "view"), "click": ("purchase", "view"), "purchase": ("view",)}
    return incremental.illegal_steps(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", allowed)


@query(
    "retry_delays",
    "SELECT event_id, least(30.0::DOUBLE * power(2.0::DOUBLE, event_id % 8), 1000.0::DOUBLE) AS delay FROM events WHERE event_type = 'error'",
)
def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'error'").select("event_id", incremental.retry_delay(F.col("event_id") % 8 + 1, 30.0, 1000.0).alias("delay"))


@query(
    "first_value_survivor_dedup",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""",
)
def survivor_dedup(spark: SparkSession, d: str) -> DataFrame:
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice"]
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    return survivors(table(spark, d, "lineitem").select(*cols), ["l_orderkey", "l_linenumber"], order).select(*cols[:5])


@query("coverage_union", "SELECT count(*) AS covered FROM (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL UNION SELECT doc_id FROM documents WHERE n_chars >= 2000)")
def coverage_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "labels").where("doc_id is not null").select("doc_id")
    return a.union(table(spark, d, "documents").where("n_chars >= 2000").select("doc_id")).distinct().agg(F.count("*").alias("covered"))
