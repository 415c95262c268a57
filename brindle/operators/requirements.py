"""What postings ask for: vocabulary entries line by line, with the strength of the line or of the heading above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import vocabularies
from brindle.functions.readers import HEADINGS, LINE_PREFERRED, LINE_REQUIRED, first_match
from brindle.operators.vocabulary import segmented, spans

STRENGTHS = ("required", "preferred", "unclassified")
CHOICE = r"(?i)\b(or|such as|e\.g\.|one of|any of)\b"


def vocabulary(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(vocabularies.parsed(text), "entry string, spelling string, cased boolean")


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs -> doc, line, said, strength: of the words on the line, else of the last heading above, else unclassified. Headings are no lines."""
    rows = docs.select(F.col(key).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "said"))
    rows = rows.withColumn("heading", first_match(F.lower(F.trim("said")), HEADINGS))
    above = F.last("heading", ignorenulls=True).over(Window.partitionBy("doc").orderBy("line"))
    low = F.lower("said")
    own = F.when(low.rlike(LINE_PREFERRED), "preferred").when(low.rlike(LINE_REQUIRED), "required")
    return rows.withColumn("above", above).where("heading IS NULL").select("doc", "line", "said", F.coalesce(own, "above", F.lit("unclassified")).alias("strength"))


def requirements(docs: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """docs -> doc, entry, strength, choice, line: each entry of the vocabulary that a document names, once, at its strongest (the earliest such line).

    choice: the line offers it among others.
    """
    rank = F.array_position(F.array(*map(F.lit, STRENGTHS)), F.col("strength"))
    # what is known of a line goes with its name, so that lines need not be joined to what was found in them
    at = F.struct("doc", rank.alias("rank"), "line", "strength", F.col("said").rlike(CHOICE).alias("choice"))
    found = segmented(spans(lines(docs, key, text).select(at.alias("at"), "said"), "at", "said", vocabulary))
    best = found.groupBy(F.col("doc.doc").alias("doc"), "entry").agg(F.min(F.struct("doc.rank", "doc.line", "doc.strength", "doc.choice")).alias("b"))
    return best.select("doc", "entry", "b.strength", "b.choice", "b.line")


def role_of(titles: DataFrame, key: str, title: str, roles: DataFrame) -> DataFrame:
    """titles -> doc, role: the longest role that a title names, the first of several; titles without one are left out."""
    found = segmented(spans(titles, key, title, roles))
    return found.groupBy("doc").agg(F.min(F.struct((-F.col("n")).alias("n"), "pos", "entry")).alias("b")).select("doc", F.col("b.entry").alias("role"))


def restricted(text: Column, pattern: str, denial: str) -> Column:
    """Whether a line of a text restricts, and does not say that it does not; null texts do not."""
    per_line = F.split(F.coalesce(text, F.lit("")), r"\n|(?<=[a-z0-9)][.!?])\s+")
    return F.exists(per_line, lambda s: s.rlike(pattern) & ~s.rlike(denial))
