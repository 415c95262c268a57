"""Terms, document frequencies, lexical ranking, chunks and duplicates of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.text import STOPWORDS, squeezed, tokens
from brindle.operators import corpus
from brindle.operators.dedup import exact_groups, jaccard_links
from brindle.operators.ranking import fuse, fuse_neutral, interleave, ranked
from brindle.plans.registry import query
from brindle.session import table, written

_JOIN = "regexp_replace({}, '([0-9]),([0-9]{{3}})([^0-9]|$)', '\\1\\2\\3', 'g')"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _tokens_sql(text: str) -> str:
    joined = _JOIN.format(_JOIN.format(_JOIN.format(f"lower(coalesce({text}, ''))")))
    return f"list_filter(list_transform(regexp_extract_all({joined}, '[a-z0-9+#.]+'), lambda t: rtrim(t, '.')), lambda t: len(t) > 1 AND t NOT IN ({_STOP}))"


_TOK = f"tok AS (SELECT doc_id, source, {_tokens_sql('text')} AS t FROM documents)"
_DF = "df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM tok) GROUP BY 1)"
_N = "n AS (SELECT count(*) AS n FROM documents WHERE trim(text) <> '')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("tokenize_df", f"WITH {_TOK}, {_DF} SELECT term, df FROM df")
def tokenize_df(spark: SparkSession, d: str) -> DataFrame:
    return corpus.document_frequencies(_docs(spark, d), "doc_id", "text")


@query("idf_table", f"WITH {_TOK}, {_DF}, {_N} SELECT term, df, round(ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1, 6) AS idf FROM df, n")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    out = corpus.with_idf(corpus.document_frequencies(docs, "doc_id", "text"), corpus.non_blank(docs, "text"))
    return out.select("term", "df", F.round("idf", 6).alias("idf"))


@query("boilerplate_terms", f"WITH {_TOK}, {_DF}, {_N} SELECT term, df > 0.3::DOUBLE * n AS common, df >= 0.6::DOUBLE * n AS boilerplate FROM df, n WHERE n >= 50 AND df > 0.1::DOUBLE * n")
def boilerplate_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    n = corpus.non_blank(docs, "text")
    df = corpus.document_frequencies(docs, "doc_id", "text").where((F.lit(n) >= corpus.LEAST_DOCUMENTS) & (F.col("df") > 0.1 * n))
    return df.select("term", (F.col("df") > corpus.COMMON_SHARE * n).alias("common"), (F.col("df") >= 0.6 * n).alias("boilerplate"))


@query(
    "tfidf_topterms",
    f"""WITH {_TOK}, {_DF}, {_N}, tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY 1, 2),
w AS (SELECT doc_id, term, round((1 + ln(tf)) * (ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1), 6) AS weight FROM tf JOIN df USING (term), n)
SELECT doc_id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rn FROM w) WHERE rn <= 5""",
)
def tfidf_topterms(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    t = corpus.term_table(docs, "doc_id", "text")
    w = corpus.with_frequencies(t.select(F.col("doc").alias("key"), "term", "tf"), written(corpus.frequencies(t), "frequencies"))
    w = corpus.with_idf(w, corpus.non_blank(docs, "text")).withColumn("weight", F.round((1 + F.log("tf")) * F.col("idf"), 6))
    rn = F.row_number().over(Window.partitionBy("key").orderBy(F.col("weight").desc(), "term"))
    return w.withColumn("rn", rn).where("rn <= 5").select(F.col("key").alias("doc_id"), "term", "weight")


_ASKED = f"q0 AS (SELECT item_id, {_tokens_sql('text')} AS t FROM benchmark)"
_SCORES = """m AS (SELECT avg(len(t))::DOUBLE AS mean FROM tok),
tf AS (SELECT doc_id, len(any_value(t)) AS len, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM tok) GROUP BY doc_id, term),
s AS (SELECT item_id, doc_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score FROM q JOIN tf USING (term), n, m GROUP BY 1, 2)"""
#: CTEs up to s(item_id, doc_id, score), the BM25 score of every pair that shares one of the item's eight rarest terms: what retrieval searches for.
BM25_SCORES = f"""{_TOK}, {_DF}, {_N}, {_ASKED},
q1 AS (SELECT item_id, term, min(place) AS place FROM (SELECT item_id, unnest(t) AS term, generate_subscripts(t, 1) AS place FROM q0) GROUP BY 1, 2),
q2 AS (SELECT item_id, term, coalesce(df, 0) AS df, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(df, 0), place) AS rn FROM q1 LEFT JOIN df USING (term), n WHERE n < 50 OR coalesce(df, 0) <= 0.3::DOUBLE * n),
q AS (SELECT * FROM q2 WHERE rn <= 8), {_SCORES}"""


@query(
    "bm25_topk",
    f"""WITH {_TOK}, {_DF}, {_N}, {_ASKED}, q AS (SELECT DISTINCT item_id, term, df FROM (SELECT item_id, unnest(t) AS term FROM q0) JOIN df USING (term)), {_SCORES}
SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM s) WHERE rn <= 10""",
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents by all terms of an item."""
    docs = _docs(spark, d)
    rows, n = corpus.term_rows(docs, "doc_id", "text"), corpus.non_blank(docs, "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), F.explode(tokens(F.col("text"))).alias("term")).distinct()
    df = corpus.frequencies(rows.select(F.explode("term").alias("term")), asked)
    best = corpus.bm25_best(rows, docs.count(), written(asked.join(df, "term"), "wanted"), n, 10)
    return best.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score")


@query(
    "lexical_hash_vectors",
    f"""WITH {_TOK}, tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY 1, 2),
c AS (SELECT doc_id, (('0x' || substr(sha256(term), 1, 8))::BIGINT % 64)::INT AS bucket, sum(1 + ln(tf)) AS w FROM tf GROUP BY 1, 2)
SELECT doc_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS value FROM c""",
)
def lexical_hash_vectors(spark: SparkSession, d: str) -> DataFrame:
    return corpus.lexical_vectors(_docs(spark, d), "doc_id", "text", 64).select(F.col("key").alias("doc_id"), "bucket", F.round("value", 6).alias("value"))


@query(
    "chunk_spans",
    """WITH l AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0)
SELECT doc_id, (375 * i)::BIGINT AS start, least(500, n - 375 * i)::BIGINT AS size FROM (SELECT *, unnest(range(0, CASE WHEN n <= 500 THEN 1 ELSE ((n - 500 + 374) // 375 + 1) END)) AS i FROM l)""",
)
def chunk_spans(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    last = F.when(n <= 500, 0).otherwise(F.ceil((n - 500) / 375)).cast("int")
    rows = _docs(spark, d).where(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return rows.select("doc_id", (F.col("i") * 375).cast("long").alias("start"), F.least(F.lit(500), F.col("n") - F.col("i") * 375).cast("long").alias("size"))


@query(
    "exact_dup_groups",
    r"""WITH x AS (SELECT source, doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS digest FROM documents)
SELECT source, digest, count(*) AS copies, max(doc_id) AS representative FROM x GROUP BY 1, 2 HAVING count(*) > 1""",
)
def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).withColumn("newest", F.col("doc_id"))
    return exact_groups(rows, ["source"], "doc_id", "text", "newest").where("copies > 1").select("source", "digest", "copies", "representative")


@query(
    "jaccard_near_dups",
    f"""WITH {_TOK}, d AS (SELECT doc_id, list_sort(list_distinct(t)) AS s FROM tok WHERE len(t) > 0), g AS (SELECT s, min(doc_id) AS doc_id FROM d GROUP BY 1), w AS (SELECT doc_id, len(s) AS n, unnest(s) AS w FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) + any_value(b.n) AS n FROM w a JOIN w b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE c / (n - c)::DOUBLE >= 0.9), l AS (SELECT k, count(*) AS links FROM (SELECT a AS k FROM e UNION ALL SELECT b FROM e) GROUP BY 1)
SELECT d.doc_id, g.doc_id AS class, coalesce(links, 0)::BIGINT AS links FROM d JOIN g ON d.s = g.s LEFT JOIN l ON l.k = g.doc_id""",
)
def jaccard_near_dups(spark: SparkSession, d: str) -> DataFrame:
    """Each document with its class (the least document of an equal word set) and the number of other classes at 0.9 or more."""
    sets = written(corpus.term_sets(_docs(spark, d), "doc_id", "text").withColumnRenamed("key", "doc_id"), "word_sets")
    one = sets.groupBy("digest").agg(F.min("doc_id").alias("class"), F.first("words").alias("words"))
    links = jaccard_links(one.select("class", "words"), "class", "words", 0.9)
    many = links.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.count("*").alias("links"))
    member = sets.select("doc_id", "digest").join(one.select("digest", "class"), "digest")
    return member.join(many, F.col("class") == F.col("k"), "left").select("doc_id", "class", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


@query("distinct_bodies", r"SELECT count(*) AS n, count(DISTINCT md5(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0B]+', ' ', 'g')))) AS bodies FROM documents")
def distinct_bodies(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).agg(F.count("*").alias("n"), F.count_distinct(F.md5(squeezed(F.col("text")))).alias("bodies"))


_RANKS = """a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
b AS (SELECT source, d.doc_id, row_number() OVER (PARTITION BY source ORDER BY quality DESC, d.doc_id) AS rank FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id)"""


def _rankings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, d).select("source", "doc_id", "n_chars")
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return ranked(docs, ["source"], "n_chars", "doc_id"), ranked(docs.join(lab, "doc_id"), ["source"], "quality", "doc_id")


@query("rrf_fuse", f"WITH {_RANKS}, u AS (SELECT source, doc_id, 1.0::DOUBLE / (60 + rank) AS part FROM a UNION ALL SELECT source, doc_id, 1.0::DOUBLE / (60 + rank) FROM b) SELECT source, doc_id, round(sum(part), 9) AS score FROM u GROUP BY 1, 2")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return fuse(list(_rankings(spark, d)), ["source"], "doc_id").withColumn("score", F.round("score", 9))


@query(
    "rrf_neutral_rank",
    f"""WITH {_RANKS}, c AS (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM a)
SELECT c.source, c.doc_id, round(1.0::DOUBLE / (60 + c.rank) + 1.0::DOUBLE / (60 + coalesce(b.rank, (n + 1) / 2.0::DOUBLE)), 9) AS score FROM c LEFT JOIN b ON c.source = b.source AND c.doc_id = b.doc_id""",
)
def rrf_neutral(spark: SparkSession, d: str) -> DataFrame:
    a, b = _rankings(spark, d)
    return fuse_neutral(a, b, ["source"], "doc_id").withColumn("score", F.round("score", 9))


@query(
    "interleave_rankings",
    f"""WITH {_RANKS}, u AS (SELECT source, doc_id, rank, 0 AS space FROM a UNION ALL SELECT source, doc_id, rank, 1 FROM b), f AS (SELECT source, doc_id, min((rank, space)) AS at1 FROM u GROUP BY 1, 2)
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY at1) AS place FROM f""",
)
def interleave_rankings(spark: SparkSession, d: str) -> DataFrame:
    return interleave(list(_rankings(spark, d)), ["source"], "doc_id").withColumn("place", F.col("place").cast("long"))
