"""What must not go through one place: plans of queries whose rows grow with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import keywords
from brindle.operators.requirements import requirements


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_requirements_send_no_lines_to_the_driver(spark, tmp_path):
    spark.range(200).select("id", F.lit("Requirements\nspark or sql\nNice to have\nkafka").alias("body")).write.parquet(f"{tmp_path}/p")
    voc = spark.createDataFrame([("sql", "sql", False), ("kafka", "kafka", False)], "entry string, spelling string, cased boolean")
    got = requirements(spark.read.parquet(f"{tmp_path}/p"), "id", "body", voc)
    assert broadcasts(got) == 1  # the vocabulary
    assert {tuple(r)[1:] for r in got.collect()} == {("sql", "required", True, 1), ("kafka", "preferred", False, 3)} and got.count() == 400


def test_keyword_hits_move_texts_only_and_take_the_shortest_of_all_forms(spark):
    docs = spark.createDataFrame([(1, "que x de one quees y de two three ques de", None)], "id long, title string, body string")
    asks = spark.createDataFrame([(1, "de que")], "q long, ask string")
    got = keywords.find_keywords(docs, "id", ["title", "body"], asks, "q", "ask")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(doc") == 1
    assert [(r.kind, r["first"], r["last"], r.match) for r in got.collect()] == [("near", 9, 10, "ques de")]
