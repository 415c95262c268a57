"""Held-out personalisation, places resolved in a hierarchy, and claims held against sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.claims import SENTENCE, sentence_words, supported
from brindle.operators.hierarchy import resolved
from brindle.operators.personal import held_out_ranking
from brindle.plans.quality_views import _S, _scored
from brindle.plans.registry import query
from brindle.session import table

FOLDS = 5
_NDCG = "coalesce(sum((power(2.0::DOUBLE, label) - 1) / log2(r + 1.0::DOUBLE)) FILTER (r <= 10) / nullif(sum((power(2.0::DOUBLE, label) - 1) / log2(i + 1.0::DOUBLE)) FILTER (i <= 10), 0), 0)"


@query(
    "held_out_personalisation",
    f"""WITH {_S}, g AS (SELECT s.doc_id, s.score, s.label, (s.doc_id % {FOLDS})::INT AS fold, ['source:' || coalesce(d.source, ''), 'lang:' || coalesce(d.lang, '')] AS traits FROM s JOIN documents d USING (doc_id)),
f AS (SELECT DISTINCT fold FROM g), t AS (SELECT g.*, unnest(traits) AS trait FROM g),
w AS (SELECT f.fold, trait, greatest(-0.3::DOUBLE, least(0.3::DOUBLE, avg(label) - (SELECT avg(label) FROM g WHERE g.fold <> f.fold))) AS weight FROM f JOIN t ON t.fold <> f.fold GROUP BY 1, 2 HAVING count(*) >= 3),
p AS (SELECT g.doc_id, g.fold, label, score, round(greatest(0, least(1, score + greatest(-0.5::DOUBLE, least(0.5::DOUBLE, coalesce((SELECT sum(weight) FROM w WHERE w.fold = g.fold AND list_contains(g.traits, w.trait)), 0))))), 6) AS personal FROM g),
b AS (SELECT fold, {_NDCG} AS ndcg, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, label, doc_id) AS r, row_number() OVER (PARTITION BY fold ORDER BY label DESC, doc_id) AS i FROM p) GROUP BY 1),
q AS (SELECT fold, {_NDCG} AS ndcg FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY personal DESC, label, doc_id) AS r, row_number() OVER (PARTITION BY fold ORDER BY label DESC, doc_id) AS i FROM p) GROUP BY 1)
SELECT fold, n, round(b.ndcg, 6) AS base_ndcg, round(q.ndcg, 6) AS personal_ndcg, CASE WHEN n < 30 THEN 'insufficient' WHEN round(q.ndcg, 6) > round(b.ndcg, 6) THEN 'better' ELSE 'no better' END AS status FROM b JOIN q USING (fold)""",
)
def held_out_personalisation(spark: SparkSession, d: str) -> DataFrame:
    """Sources and languages as preferences: learned in four folds, tried on the fifth."""
    graded = _scored(spark, d).select(F.col("doc_id").alias("key"), (F.col("doc_id") % FOLDS).cast("int").alias("fold"), "score", F.col("label").alias("grade"))
    trait = lambda c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c), F.lit("")))
    traits = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.explode(F.array(trait("source"), trait("lang"))).alias("trait"))
    out = held_out_ranking(graded, traits, FOLDS)
    return out.select("fold", "n", *[F.round(c, 6).alias(c) for c in ("base_ndcg", "personal_ndcg")], "status")


_PLACE = "CASE c.c_custkey % 6 WHEN 0 THEN n.n_name WHEN 1 THEN 'Office in ' || lower(n.n_name) || ', ' || r.r_name WHEN 2 THEN n.n_name || ' or ' || m.n_name WHEN 3 THEN r.r_name || '; ' || n.n_name WHEN 4 THEN n.n_name || ', ' || m.n_name ELSE 'remote' END"
_NODES = "nd AS (SELECT r_name AS node, 'WORLD/' || r_name AS path FROM region UNION ALL SELECT n_name, 'WORLD/' || r_name || '/' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey)"


@query(
    "place_resolution",
    f"""WITH {_NODES}, t AS (SELECT c_custkey AS customer, {_PLACE} AS place FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey JOIN nation m ON m.n_nationkey = (c.c_nationkey + c.c_custkey // 6) % 25),
o AS (SELECT customer, unnest(string_split_regex(place, ';| or ')) AS office, unnest(range(1, len(string_split_regex(place, ';| or ')) + 1)) AS part FROM t),
f AS (SELECT customer, part, path FROM o JOIN nd ON regexp_matches(lower(office), '(^|[^a-z0-9_])' || lower(node) || '($|[^a-z0-9_])')),
l AS (SELECT * FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.customer = a.customer AND b.part = a.part AND starts_with(b.path, a.path || '/'))),
x AS (SELECT customer, count(DISTINCT part) AS offices, list(string_split(path, '/')) AS paths FROM l GROUP BY 1),
y AS (SELECT customer, offices, list_filter([1, 2, 3], lambda k: len(list_distinct(list_transform(paths, lambda p: coalesce(p[k], '')))) = 1 AND paths[1][k] IS NOT NULL) AS lv, paths[1] AS p1 FROM x),
z AS (SELECT customer, offices, p1[len(lv)] AS node FROM y)
SELECT t.customer, coalesce(offices, 0) AS offices, node FROM t LEFT JOIN z USING (customer)""",
)
def place_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Where customers say they are, in words of nations and regions: the most specific place that holds all that is named."""
    n, r, c = (table(spark, d, t) for t in ("nation", "region", "customer"))
    nr = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    other = n.select(F.col("n_nationkey").alias("m_key"), F.col("n_name").alias("m_name"))
    rows = c.join(F.broadcast(nr), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(other), F.col("m_key") == (F.col("c_nationkey") + F.floor(F.col("c_custkey") / 6)) % 25)  # 25 nations
    place, k = F.lit("remote"), F.col("c_custkey") % 6
    forms = [F.col("n_name"), F.concat(F.lit("Office in "), F.lower("n_name"), F.lit(", "), F.col("r_name")), F.concat_ws(" or ", "n_name", "m_name"), F.concat_ws("; ", "r_name", "n_name"), F.concat_ws(", ", "n_name", "m_name")]
    for i, form in enumerate(forms):
        place = F.when(k == i, form).otherwise(place)
    nodes = nr.select(F.col("n_name").alias("node"), F.col("r_name").alias("parent")).unionByName(r.select(F.col("r_name").alias("node"), F.lit("WORLD").alias("parent"))).unionByName(r.select(F.lit("WORLD").alias("node"), F.lit(None).cast("string").alias("parent")).distinct())
    names = nodes.where("parent IS NOT NULL").select("node", F.col("node").alias("spelling"))
    got = resolved(rows.select("c_custkey", place.alias("place")), "c_custkey", "place", names, nodes, apart="; | or ")
    return got.select(F.col("doc").alias("customer"), "offices", "node")


_SAID = "'[0-9][0-9.,]*[0-9]%?|[0-9]%?|\\p{L}[\\p{L}0-9+#-]*'"
_SENTENCES = "string_split_regex({}, '[.!?]+\\s+|\\n+')"
_NORMAL = "CASE WHEN regexp_matches({0}, '^[0-9]') THEN replace(lower({0}), ',', '') WHEN length(lower({0})) >= 4 AND lower({0}) LIKE '%s' THEN left(lower({0}), length(lower({0})) - 1) ELSE lower({0}) END"


@query(
    "claim_support",
    f"""WITH s AS (SELECT doc_id, {_SENTENCES.format('text')}[2] AS said FROM documents WHERE doc_id % 50 = 0 AND len({_SENTENCES.format('text')}) > 1),
l AS (SELECT doc_id, said, list_reduce(list_prepend('', regexp_extract_all(said, {_SAID})), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS long FROM s),
c AS (SELECT doc_id * 2 AS claim, said FROM l UNION ALL SELECT doc_id * 2 + 1, replace(said, long, reverse(long) || 'qx') FROM l WHERE long <> ''),
w AS (SELECT claim, w, i FROM (SELECT claim, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM (SELECT claim, regexp_extract_all(said, {_SAID}) AS ws FROM c))),
n AS (SELECT DISTINCT claim, {_NORMAL.format('w')} AS word, CASE WHEN regexp_matches(w, '^(19|20)[0-9]{{2}}$') THEN 'year' WHEN regexp_matches(w, '^[0-9]') THEN 'figure' WHEN regexp_matches(w, '^\\p{{Lu}}{{2,}}[0-9]*$') THEN 'acronym' WHEN i > 0 AND regexp_matches(w, '^\\p{{Lu}}\\p{{Ll}}') THEN 'name' WHEN length(w) >= 7 THEN 'term' END AS kind FROM w),
k AS (SELECT claim, count(DISTINCT word) AS n, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM n WHERE kind IS NOT NULL GROUP BY 1),
r AS (SELECT DISTINCT doc_id, sentence, {_NORMAL.format('w')} AS word FROM (SELECT doc_id, sentence, unnest(regexp_extract_all(said, {_SAID})) AS w FROM (SELECT doc_id, unnest({_SENTENCES.format('text')}) AS said, unnest(range(0, len({_SENTENCES.format('text')}))) AS sentence FROM documents))),
h AS (SELECT claim, doc_id, sentence, count(*) AS m FROM (SELECT DISTINCT claim, word FROM n WHERE kind IS NOT NULL) JOIN r USING (word) GROUP BY 1, 2, 3),
g AS (SELECT claim, count(DISTINCT doc_id) AS support, min(doc_id) AS first FROM h JOIN k USING (claim) WHERE m = n GROUP BY 1)
SELECT c.claim, c.claim % 2 = 1 AS planted, coalesce(n, 0) AS n, coalesce(kinds, '') AS kinds, coalesce(support, 0) AS support, first FROM c LEFT JOIN k USING (claim) LEFT JOIN g USING (claim)""",
)
def claim_support(spark: SparkSession, d: str) -> DataFrame:
    """The second sentence of a document in fifty as a claim, and the same with its longest word made up, held against all documents."""
    docs = table(spark, d, "documents")
    said = docs.where("doc_id % 50 = 0").select("doc_id", F.get(F.split("text", SENTENCE), F.lit(1)).alias("said")).where("said IS NOT NULL")
    words = F.element_at(sentence_words(F.col("said")), 1)
    long = F.aggregate(words, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    rows = said.select("doc_id", "said", long.alias("long"))
    false = rows.where("long != ''").select((F.col("doc_id") * 2 + 1).alias("claim"), F.replace("said", "long", F.concat(F.reverse("long"), F.lit("qx"))).alias("text"))
    got = supported(rows.select((F.col("doc_id") * 2).alias("claim"), F.col("said").alias("text")).unionByName(false), "claim", docs, "doc_id")
    return got.select("claim", (F.col("claim") % 2 == 1).alias("planted"), "n", F.array_join("kinds", ",").alias("kinds"), "support", "first")
