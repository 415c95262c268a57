"""Keywords, vocabularies and passages over whole documents; the SQL reads word lists and knows nothing of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators.keywords import find_keywords, said_words, top_passages
from brindle.operators.vocabulary import runs, segmented, spans
from brindle.plans.registry import query
from brindle.session import small_enough, table, written

_WORD = "'\\.?[A-Za-z0-9]+(?:\\.[A-Za-z0-9]+)*[+#]*'"
#: Every document whose id is divisible by this asks: two words of its own that follow each other, or words of its beginning turned round.
EVERY = 50


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a title (the first line) and a body."""
    docs = table(spark, d, "documents")
    line = F.instr("text", "\n")
    return docs.select("doc_id", "text", F.substring_index("text", "\n", 1).alias("title"), F.when(line > 0, F.substring(F.col("text"), line + 1, F.length("text"))).otherwise("").alias("body"))


def _questions(docs: DataFrame) -> DataFrame:
    asks = docs.where(F.col("doc_id") % EVERY == 0).select("doc_id", said_words(F.col("text")).alias("w"))
    pick = lambda *at: F.array_join(F.array_compact(F.array(*[F.get("w", F.lit(i)) for i in at])), " ")
    kind = F.col("doc_id") / EVERY % 4
    return asks.select(F.col("doc_id").alias("question"), F.when(kind == 0, pick(5, 6)).when(kind == 1, pick(2, 0)).when(kind == 2, pick(3, 1, 2)).otherwise(pick(7)).alias("ask"))


_ASKS = f"""q AS (SELECT doc_id AS question, list_transform(list_filter(CASE doc_id // {EVERY} % 4 WHEN 0 THEN [w[6], w[7]] WHEN 1 THEN [w[3], w[1]] WHEN 2 THEN [w[4], w[2], w[3]] ELSE [w[8]] END, lambda x: x IS NOT NULL), lambda x: lower(x)) AS qw
 FROM (SELECT doc_id, regexp_extract_all(text, {_WORD}) AS w FROM documents WHERE doc_id % {EVERY} = 0))"""
_SAME = "(lw[i + k + 1] = qw[k + 1] OR lw[i + k + 1] = qw[k + 1] || 's' OR lw[i + k + 1] = qw[k + 1] || 'es')"
_HAS = "len(list_filter(list_slice(lw, i + 1, i + m), lambda x: x IN (w, w || 's', w || 'es'))) > 0"


@query(
    "keyword_hits",
    f"""WITH {_ASKS}, t AS (SELECT doc_id, 0 AS field, regexp_extract_all(split_part(text, chr(10), 1), {_WORD}) AS rw FROM documents
 UNION ALL SELECT doc_id, 1, regexp_extract_all(CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END, {_WORD}) FROM documents),
f AS (SELECT *, list_transform(rw, lambda x: lower(x)) AS lw FROM t),
c AS (SELECT question, qw, doc_id, field, lw, rw FROM q, f WHERE len(qw) > 0 AND len(list_filter(qw, lambda w: len(list_filter(lw, lambda x: x IN (w, w || 's', w || 'es'))) = 0)) = 0),
ph AS (SELECT question, doc_id, field, min(i) AS first, min(i) + len(any_value(qw)) - 1 AS last FROM (SELECT *, unnest(range(0, len(lw) - len(qw) + 1)) AS i FROM c)
 WHERE len(list_filter(range(0, len(qw)), lambda k: {_SAME})) = len(qw) GROUP BY 1, 2, 3),
nr AS (SELECT question, doc_id, first, last FROM (SELECT *, unnest(range(1, len(qw) + 3)) AS m FROM (SELECT *, unnest(range(0, len(lw))) AS i FROM c WHERE field = 0 AND len(qw) > 1)) , LATERAL (SELECT i AS first, i + m - 1 AS last)
 WHERE i + m <= len(lw) AND len(list_filter(qw, lambda w: {_HAS})) = len(qw) QUALIFY row_number() OVER (PARTITION BY question, doc_id ORDER BY m, i) = 1),
h AS (SELECT question, doc_id, field, 'phrase' AS kind, first, last FROM ph UNION ALL SELECT question, doc_id, 0, 'near', first, last FROM nr),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY question, doc_id ORDER BY field, kind = 'near') = 1)
SELECT question, doc_id, field, kind, first, last, CASE WHEN first > 2 THEN '… ' ELSE '' END || array_to_string(list_slice(rw, greatest(first - 1, 1), first), ' ') AS before, array_to_string(list_slice(rw, first + 1, last + 1), ' ') AS match,
 array_to_string(list_slice(rw, last + 2, last + 3), ' ') || CASE WHEN last + 3 < len(rw) THEN ' …' ELSE '' END AS after FROM b JOIN f USING (doc_id, field)""",
)
def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    """Where every document says what a document in fifty asks, with the words around it."""
    docs = _fields(spark, d)
    got = find_keywords(docs, "doc_id", ["title", "body"], _questions(docs), "question", "ask").withColumnRenamed("doc", "doc_id")
    return got.select("question", "doc_id", "field", "kind", *[F.col(c).cast("long").alias(c) for c in ("first", "last")], "before", "match", "after")


@query(
    "passage_windows",
    f"""WITH q AS (SELECT item_id AS question, list_slice(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, {_WORD}), lambda x: lower(x)), lambda x: len(x) >= 6))), 1, 8) AS qw FROM benchmark),
p AS (SELECT doc_id, lower(w) AS word, i - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, {_WORD}) AS ws FROM documents), LATERAL (SELECT unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i)),
h0 AS (SELECT question, doc_id, word, pos FROM p JOIN (SELECT question, unnest(qw) AS word FROM q) USING (word)),
k AS (SELECT question, doc_id, count(DISTINCT word) AS held FROM h0 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY question ORDER BY held DESC, doc_id) <= 10),
h AS (SELECT h0.* FROM h0 JOIN k USING (question, doc_id)),
e AS (SELECT a.question, a.doc_id, a.pos AS last, min(z.at) AS first, count(*) AS n FROM h a, LATERAL (SELECT word, max(pos) AS at FROM h b WHERE b.question = a.question AND b.doc_id = a.doc_id AND b.pos <= a.pos GROUP BY 1) z GROUP BY 1, 2, 3)
SELECT question, doc_id, held, first, last FROM e JOIN k USING (question, doc_id) WHERE n = held QUALIFY row_number() OVER (PARTITION BY question, doc_id ORDER BY last - first, first) = 1""",
)
def passage_windows(spark: SparkSession, d: str) -> DataFrame:
    """The shortest stretch that holds most of a benchmark item's longer words, in the ten documents that hold the most of them."""
    words = lambda c: F.transform(said_words(F.col(c)), F.lower)
    long = F.slice(F.array_sort(F.array_distinct(F.filter(words("text"), lambda x: F.length(x) >= 6))), 1, 8)
    terms = table(spark, d, "benchmark").select(F.col("item_id").alias("question"), F.explode(long).alias("word"))
    docs = table(spark, d, "documents")
    held = docs.select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(words("text"))).alias("word")).join(F.broadcast(terms) if small_enough(terms, 100_000) else terms, "word")
    counted = held.groupBy("question", "doc").agg(F.count("*").alias("n"))
    best = counted.withColumn("rn", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("n"), "doc"))).where("rn <= 10")
    got = top_passages(docs, "doc_id", "text", written(best.select("question", "doc"), "best"), terms).withColumnRenamed("doc", "doc_id")
    return got.select("question", "doc_id", "held", *[F.col(c).cast("long").alias(c) for c in ("first", "last")])


_VOC = f"""v AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(text, {_WORD}) AS w FROM benchmark)),
e AS (SELECT lower(array_to_string(list_slice(w, i, i + n - 1), ' ')) AS spelling, n FROM v, (VALUES (2), (3), (5)) s(n) WHERE (i - 1) % n = 0 AND i + n - 1 <= len(w) GROUP BY ALL)"""


@query(
    "vocabulary_spans",
    f"""WITH RECURSIVE {_VOC},
d AS (SELECT doc_id, regexp_extract_all(text, {_WORD}) AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS said FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (VALUES (2), (3), (5)) s(n) WHERE i + n - 1 <= len(w)),
s AS MATERIALIZED (SELECT doc_id, pos, max(n) AS n FROM g WHERE lower(said) IN (SELECT spelling FROM e) GROUP BY 1, 2),
t AS (SELECT doc_id, min(pos) AS pos FROM s GROUP BY 1 UNION ALL SELECT doc_id, (SELECT min(s.pos) FROM s WHERE s.doc_id = t.doc_id AND s.pos >= t.pos + (SELECT n FROM s x WHERE x.doc_id = t.doc_id AND x.pos = t.pos)) FROM t WHERE t.pos IS NOT NULL)
SELECT doc_id, pos, n, lower(said) AS entry, said FROM t JOIN s USING (doc_id, pos) JOIN g USING (doc_id, pos, n)""",
)
def vocabulary_spans(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut by a vocabulary of two, three and five words in a row of benchmark items, which has hundreds of entries and grows with them."""
    several = F.transform(F.array(said_words(F.col("text"))), lambda w: runs(w, [2, 3, 5], apart=True)).getItem(0)
    said = table(spark, d, "benchmark").select(F.explode(several).alias("r")).select(F.lower("r.said").alias("spelling")).distinct()
    voc = said.select(F.col("spelling").alias("entry"), "spelling", F.lit(False).alias("cased"))
    got = segmented(spans(table(spark, d, "documents"), "doc_id", "text", voc))
    return got.select(F.col("doc").alias("doc_id"), F.col("pos").cast("long").alias("pos"), "n", "entry", "said")
