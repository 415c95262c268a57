"""Files kept by hand, written from the tables a bounded number of entries a file and read back, and a traced retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.ranking import fuse
from brindle.plans.registry import query
from brindle.plans.retrieval_views import _HYBRID, POOL, pools
from brindle.session import shared_dir, table, written_files
from brindle.sources import sets
from brindle.trace import Trace

#: Entries of one file.
ENTRIES = 200


def _written(df: DataFrame, label: str) -> str:
    """df(file, value) -> a folder with a text file for each file number."""
    path = f"{shared_dir(df.sparkSession)}/brindle/{label}-{uuid.uuid4().hex}"
    return written_files(path, lambda p: df.repartition("file").write.partitionBy("file").text(p)) + "/*"


@query(
    "registry_files",
    "SELECT s_suppkey % 7 = 0 AS retired, s_name AS name, 'board-' || s_suppkey AS slug, CASE s_suppkey % 3 WHEN 0 THEN 'lever' ELSE 'greenhouse' END AS ats, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 60 END AS poll_interval_s, CASE WHEN s_suppkey % 5 = 0 THEN 'it''s \"' || s_name || '\"' || chr(10) || '# \\ ok: ' || s_suppkey END AS state FROM supplier",
)
def registry_files(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as registries of companies, some retired, with quotes, newlines, comment signs and backslashes in a field."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(
        F.floor(k / ENTRIES).alias("file"), F.when(k % 7 == 0, "retired").otherwise("companies").alias("section"), k.alias("order"), F.col("s_name").alias("name"), F.concat(F.lit("board-"), k.cast("string")).alias("slug"),
        F.when(k % 3 == 0, "lever").alias("ats"), F.when(k % 2 == 0, k * 60).alias("poll_interval_s"), F.when(k % 5 == 0, F.concat(F.lit("it's \""), "s_name", F.lit('"\n# \\ ok: '), k.cast("string"))).alias("state"),
    )
    on, off = sets.registry(spark, _written(sets.yaml_text(s, "file", "section", "order", ("companies", "retired")), "registry"))
    return on.withColumn("retired", F.lit(False)).unionByName(off.withColumn("retired", F.lit(True))).drop("checked")


@query(
    "labelled_files",
    "SELECT 'd' || d.doc_id AS key, substr(d.text, 1, 60) AS title, substr(d.text, 1, 300) AS description, l.quality AS relevance, CASE WHEN d.doc_id % 2 = 0 THEN 'owner' ELSE 'feedback' END AS provenance, coalesce(d.source, '') AS company, 'Remote' AS location FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id) WHERE trim(d.text) <> '' AND quality IS NOT NULL",
)
def labelled_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a quality label as labelled sets."""
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("relevance")).where("relevance IS NOT NULL")
    k = F.col("doc_id")
    rows = table(spark, d, "documents").where("trim(text) <> ''").join(lab, "doc_id").select(
        F.floor(k / ENTRIES).alias("file"), F.lit("postings").alias("section"), k.alias("order"), F.concat(F.lit("d"), k.cast("string")).alias("key"), F.substring("text", 1, 60).alias("title"), F.substring("text", 1, 300).alias("description"),
        "relevance", F.when(k % 2 == 0, "owner").otherwise("feedback").alias("provenance"), F.col("source").alias("company"),
    )
    return sets.labelled_set(spark, _written(sets.yaml_text(rows, "file", "section", "order", ("postings",)), "labelled")).drop("file")


@query(
    "question_files",
    "SELECT 'v1' AS version, 10 AS depth, 'q' || doc_id AS key, substr(text, 1, 80) AS question, coalesce(lang, 'none') AS stratum, ['answer', 'none', 'not_searched'][1 + (doc_id % 3)::INT] AS expect, ('0x' || substr(sha256('q' || doc_id), 1, 2))::INT * 100 // 256 < 30 AS held_out FROM (SELECT doc_id, any_value(text) AS text, any_value(lang) AS lang FROM documents GROUP BY 1)",
)
def question_files(spark: SparkSession, d: str) -> DataFrame:
    """Beginnings of documents as JSON question sets, of which a share by digest is held out."""
    docs = table(spark, d, "documents").dropDuplicates(["doc_id"])
    k = F.col("doc_id")
    q = F.struct(F.concat(F.lit("q"), k.cast("string")).alias("key"), F.substring("text", 1, 80).alias("question"), F.coalesce("lang", F.lit("none")).alias("stratum"), F.element_at(F.array(*map(F.lit, sets.EXPECTS)), (k % 3 + 1).cast("int")).alias("expect"))
    files = docs.groupBy(F.floor(k / ENTRIES).alias("file")).agg(F.collect_list(q).alias("questions"))
    text = F.to_json(F.struct(F.lit("v1").alias("version"), F.lit(10).alias("depth"), F.create_map(F.lit("plain"), F.create_map(F.lit("rerank"), F.lit("off"))).alias("modes"), "questions"))
    return sets.question_set(spark, _written(files.select("file", text.alias("value")), "questions"))


@query(
    "directory_files",
    "SELECT DISTINCT * FROM (SELECT lower(['Lever', 'ashby'][1 + (c_custkey % 2)::INT]) AS vendor, 'b' || c_custkey // 3 AS slug, c_mktsegment || ', Inc' AS company FROM customer UNION ALL SELECT 'greenhouse', 'b' || s_suppkey, s_name FROM supplier)",
)
def directory_files(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers as board directories in both published forms, as one."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    one = c.select(F.element_at(F.array(F.lit("Lever"), F.lit("ashby")), (F.col("c_custkey") % 2 + 1).cast("int")).alias("ats_vendor"), F.concat(F.lit(" b"), F.floor(F.col("c_custkey") / 3).cast("string")).alias("board_slug"), F.concat("c_mktsegment", F.lit(", Inc")).alias("company_name"), F.lit("x").alias("more"))
    two = s.select(F.col("s_name").alias("company"), F.lit("GREENHOUSE").alias("platform"), F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("token"))
    paths = [written_files(f"{shared_dir(spark)}/brindle/directory-{uuid.uuid4().hex}", lambda p, df=df: df.write.csv(p, header=True, escape='"')) for df in (one, two)]
    return sets.board_directories(spark, paths)


@query("stage_trace", f"WITH {_HYBRID} SELECT * FROM (SELECT 0 AS place, 'keyword' AS stage, count(*) AS items, true AS success FROM kw WHERE rank <= {POOL} UNION ALL SELECT 1, 'dense', count(*), true FROM dn WHERE rank <= {POOL} UNION ALL SELECT 2, 'fused', count(*), true FROM fu)")
def stage_trace(spark: SparkSession, d: str) -> DataFrame:
    """What each stage of the hybrid retrieval gave; the trace also has their times."""
    t = Trace()
    kw, near = pools(spark, d)
    kept = [t.stage("keyword", lambda: kw), t.stage("dense", lambda: near)]
    t.stage("fused", lambda: fuse(kept, ["item_id"], "doc_id"))
    return t.table(spark).where("elapsed_ms > 0").drop("elapsed_ms")
