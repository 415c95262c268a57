"""Résumés, dependency files, company names, confirmed boards, differences of texts and answers about sponsorship and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import papers, readers, text
from brindle.functions.vectors import halved
from brindle.operators import diff, linkage
from brindle.plans.posting_views import _MENTIONS, POSTINGS, mentions, postings
from brindle.plans.registry import query
from brindle.session import small_enough, table, written

MOST_BROADCAST = 100_000

#: Each list is walked at a pace of its own, prime to its length.
PACES = (5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
#: A résumé's lines are picked from these lists by its customer's key.
LINES = {
    "mail": ["me@mail.example", "", "first.last@mail.example"],
    "phone": ["+1 555 0100 200", ""],
    "link": ["https://code.example/me", "", "https://me.example"],
    "work": ["Experience", "WORK EXPERIENCE:", "Employment History", "Things done"],
    "job": ["Staff Engineer, Acme Mar 2021 - Present", "Engineer May 2019 -", "Developer, 2017 to 2019", "Mar 2021 - Present", "Built Kafka pipelines", "Analyst 2016"],
    "bullet": ["Ran Spark and SQL jobs", "x" * 301, "Kept Kubernetes alive"],
    "school": ["Education", "Academic Background", ""],
    "degree": ["BSc, Summer 2014", "2015", "MSc 06/2012 - 09/2014", "HOBBIES & MORE"],
    "skills": ["Technical Skills:", "Skills", "Selected Projects"],
    "tools": ["Python, Spark and Go", "SQL", "Kafka; K8s", ""],
}


def _line(name: str):
    pace = PACES[list(LINES).index(name)]
    return F.element_at(F.array(*[F.lit(x) for x in LINES[name]]), (F.floor(F.col("c_custkey") * pace / 2) % len(LINES[name]) + 1).cast("int"))


def _line_sql(name: str) -> str:
    pace = PACES[list(LINES).index(name)]
    return f"([{', '.join(repr(x) for x in LINES[name])}])[(1 + floor(c_custkey * {pace} / 2.0::DOUBLE)::BIGINT % {len(LINES[name])})::INT]"


def resumes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("resume"), F.concat_ws("\n", "c_name", *[_line(x) for x in LINES]).alias("text"))


_RESUMES = f"r AS (SELECT c_custkey AS resume, concat_ws(chr(10), c_name, {', '.join(_line_sql(x) for x in LINES)}) AS text FROM customer)"
_OPENS = "CASE " + " ".join(f"WHEN regexp_matches(lower(trim(line)), '{p}') THEN '{n}'" for n, p in papers.SECTIONS) + " END"
_SECTIONED = f"""{_RESUMES}, l AS (SELECT resume, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM r),
o AS (SELECT *, {_OPENS} AS own FROM l WHERE trim(line) <> ''),
s AS (SELECT resume, pos, line, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY resume ORDER BY pos), 'preamble') AS section FROM o QUALIFY own IS NULL)"""


@query("resume_sections", f"WITH {_SECTIONED} SELECT resume, section, count(*) AS lines FROM s GROUP BY 1, 2")
def resume_sections(spark: SparkSession, d: str) -> DataFrame:
    return papers.sections(resumes(spark, d), "resume", "text").groupBy("resume", "section").agg(F.count("*").alias("lines"))


_ONLY = f"nullif(regexp_extract(line, '(?i){papers.DATE_ONLY}', 1), '')"
_BEHIND = f"nullif(regexp_extract(line, '(?i){papers.TRAILING}', 1), '')"


@query("resume_dates", f"WITH {_SECTIONED} SELECT resume, pos, {_ONLY} AS date_only, CASE WHEN {_ONLY} IS NULL THEN {_BEHIND} END AS trailing, regexp_matches(line, '(?i){papers.OPEN_END}') AS open_ended FROM s WHERE section = 'experience'")
def resume_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates of the lines under experience: alone, behind something, or without an end."""
    s, line = papers.sections(resumes(spark, d), "resume", "text").where("section = 'experience'"), F.col("line")
    return s.select("resume", F.col("at").cast("long").alias("pos"), papers.date_only(line).alias("date_only"), papers.trailing_date(line).alias("trailing"), papers.open_ended(line).alias("open_ended"))


_DATED = f"regexp_matches(line, '(?i){papers.ANY_DATE}')"
_FOUND = f"""f AS (SELECT resume, (NOT regexp_matches(text, '{papers.EMAIL}'))::INT AS no_email, (NOT regexp_matches(text, '{papers.PHONE}'))::INT AS no_phone, (NOT regexp_matches(text, '{papers.LINK}'))::INT AS no_links FROM r),
g AS (SELECT resume, (count(*) FILTER (section = 'experience') = 0)::INT AS no_experience, (count(*) FILTER (section = 'education') = 0)::INT AS no_education, (count(*) FILTER (section = 'skills') = 0)::INT AS no_skills,
(count(*) FILTER (section IN ('experience', 'education') AND {_DATED}) = 0)::INT AS no_dates, count(*) FILTER (section <> 'preamble' AND regexp_matches(line, '{papers.HEADING}') AND NOT {_DATED}) AS unrecognized_heading,
count(*) FILTER (section IN ('experience', 'education') AND regexp_matches(line, '(?i){papers.OPEN_END}')) AS open_ended_date, count(*) FILTER (section IN ('experience', 'projects') AND length(line) > {papers.LONGEST_BULLET}) AS overlong_bullet FROM s GROUP BY 1)"""
_COST = " + ".join(f"CASE WHEN {n} > 0 THEN {c} * (2 - pow(2.0::DOUBLE, 1 - {n})) ELSE 0 END" for n, c in papers.COSTS.items())


@query(
    "ats_scores",
    f"""{_MENTIONS}, {_SECTIONED.replace('l AS (SELECT resume', 'rl AS (SELECT resume').replace('FROM l WHERE', 'FROM rl WHERE').replace(', s AS (', ', rs AS (').replace(chr(10) + 's AS (', chr(10) + 'rs AS (')}, {_FOUND.replace('FROM s GROUP', 'FROM rs GROUP')},
e AS (SELECT resume, round(greatest(0, 1 - ({_COST})), 3) AS parse FROM f JOIN g USING (resume)),
asked AS (SELECT posting_id, skill, place FROM m WHERE firm < 4),
c AS (SELECT posting_id, round(count(*) FILTER (regexp_matches(r.text, p.pattern)) / count(*)::DOUBLE, 3) AS keywords, count(*) AS asked FROM asked JOIN r ON r.resume = posting_id JOIN (SELECT unnest([{', '.join(f"'{k}'" for k, _ in readers.SKILLS)}]) AS skill, unnest([{', '.join(f"'{p}'" for _, p in readers.SKILLS)}]) AS pattern) p USING (skill) GROUP BY 1)
SELECT resume, parse, coalesce(keywords, 0) AS keywords, coalesce(asked, 0) AS asked FROM e LEFT JOIN c ON posting_id = resume""",
)
def ats_scores(spark: SparkSession, d: str) -> DataFrame:
    """How well each résumé parses, and what share of the skills that its posting requires or prefers it names."""
    r = resumes(spark, d)
    asks = mentions(postings(spark, d)).where("strength <> 'unclassified'").groupBy(F.col("posting_id").alias("resume")).agg(F.collect_set("skill").alias("asks"))
    has = readers.skills_in(F.col("text"))
    j = papers.defects(r, "resume", "text").select("resume", "parse").join(r.select("resume", has.alias("has")), "resume").join(asks, "resume", "left")
    n = F.coalesce(F.size("asks"), F.lit(0))
    share = F.coalesce(F.round(F.size(F.array_intersect("asks", "has")) / n, 3), F.lit(0.0))
    return j.select("resume", "parse", F.when(F.col("asks").isNull(), 0.0).otherwise(share).alias("keywords"), F.when(F.col("asks").isNull(), 0).otherwise(n).cast("long").alias("asked"))


@query(
    "project_ranking",
    f"""{_MENTIONS}, need AS (SELECT posting_id, skill FROM m WHERE firm < 2), n AS (SELECT posting_id, count(*) AS needs FROM need GROUP BY 1),
pr AS (SELECT s_suppkey AS project, s_nationkey AS owner, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - (s_suppkey % 500) / 365.0::DOUBLE)) AS recency, least(1.0::DOUBLE, 0.4::DOUBLE + CASE WHEN s_acctbal > 0 THEN 0.2::DOUBLE ELSE 0 END + least(s_suppkey % 80, 50) / 50.0::DOUBLE * 0.2::DOUBLE) AS substance FROM supplier),
own AS (SELECT s_suppkey AS project, unnest(list_distinct([(['python', 'go', 'kafka', 'sql', 'spark', 'kubernetes'])[1 + s_suppkey % 6], (['python', 'go', 'kafka', 'sql', 'spark', 'kubernetes'])[1 + (s_suppkey // 6) % 6]])) AS skill FROM supplier),
hits AS (SELECT posting_id, own.project, count(*) AS hit FROM need JOIN own USING (skill) JOIN pr ON pr.project = own.project AND pr.owner = posting_id % 25 GROUP BY 1, 2),
sc AS (SELECT posting_id, project, round((hit + 0.1::DOUBLE * (0.5::DOUBLE * hit / needs + 0.3::DOUBLE * recency + 0.2::DOUBLE * substance)) / (needs + 0.1::DOUBLE), 6) AS score FROM hits JOIN n USING (posting_id) JOIN pr USING (project))
SELECT posting_id, project, score FROM sc QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY score DESC, project) <= 3""",
)
def project_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The three projects of a posting's owner that meet most of its required skills; likeness, recency and substance break ties only."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    names = F.array(*[F.lit(n) for n, _ in readers.SKILLS])
    recency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (k % 500) / 365.0))
    substance = F.least(F.lit(1.0), 0.4 + F.when(F.col("s_acctbal") > 0, 0.2).otherwise(0.0) + F.least(k % 80, F.lit(50)) / 50.0 * 0.2)
    own = F.explode(F.array_distinct(F.array(F.element_at(names, (k % 6 + 1).cast("int")), F.element_at(names, (F.floor(k / 6) % 6 + 1).cast("int")))))
    p = s.select(k.alias("project"), F.col("s_nationkey").cast("long").alias("owner"), (0.3 * recency + 0.2 * substance).alias("tie"), own.alias("skill"))
    need = mentions(postings(spark, d)).where("strength = 'required'").groupBy("posting_id").agg(F.array_sort(F.collect_list("skill")).alias("skills")).withColumn("owner", F.col("posting_id") % 25)
    # postings of one owner that require the same have the same three: projects are ranked once for all of them
    asked = need.select("owner", "skills").distinct().select("owner", "skills", F.explode("skills").alias("skill"))
    h = asked.join(p, ["owner", "skill"]).groupBy("owner", "skills", "project", "tie").agg(F.count("*").alias("hit")).withColumn("needs", F.size("skills"))
    score = F.round((F.col("hit") + 0.1 * (0.5 * F.col("hit") / F.col("needs") + F.col("tie"))) / (F.col("needs") + 0.1), 6)
    w = Window.partitionBy("owner", "skills").orderBy(F.col("score").desc(), "project")
    best = h.withColumn("score", score).withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("owner", "skills", "project", "score")
    best = written(best, "ranked_projects")
    return need.join(F.broadcast(best) if small_enough(best, MOST_BROADCAST) else best, ["owner", "skills"]).select("posting_id", "project", "score")


@query(
    "declared_packages",
    "SELECT s_suppkey AS file, CASE s_suppkey % 4 WHEN 0 THEN ['lib-' || s_suppkey, 'numpy', 'torch'] WHEN 1 THEN ['jest', 'react', 'web-' || s_suppkey] WHEN 2 THEN ['crate-' || s_suppkey, 'serde'] ELSE [] END AS packages FROM supplier",
)
def declared_packages(spark: SparkSession, d: str) -> DataFrame:
    """Packages out of three kinds of dependency files; a broken one declares none."""
    k = F.col("s_suppkey")
    key = k.cast("string")
    path = F.element_at(F.array(F.lit("a/requirements-dev.txt"), F.lit("package.json"), F.lit("x/Cargo.toml"), F.lit("package.json")), (k % 4 + 1).cast("int"))
    body = (
        F.when(k % 4 == 0, F.concat(F.lit("# tools\nTorch>=2.0\nlib_"), key, F.lit("[extra]==1.0 ; python_version > '3'\n-r base.txt\nnumpy\n")))
        .when(k % 4 == 1, F.concat(F.lit('{"dependencies": {"React": "18", "web-'), key, F.lit('": "*"}, "devDependencies": {"jest": "1"}}')))
        .when(k % 4 == 2, F.concat(F.lit('[package]\nname = "x"\n\n[dependencies]\nserde = "1"\n\n[dev-dependencies]\ncrate_'), key, F.lit(' = { version = "1" }\n[features]\nfast = []\n')))
        .otherwise(F.lit('{"dependencies": '))
    )
    return table(spark, d, "supplier").select(k.alias("file"), papers.packages_in(path, body).alias("packages"))


# ------------------------------------------------- companies

_NAMES = ["Baker", "Join (Northwind)", "River Works GmbH", "Fast", "Olive & Stone Inc", "Nova"]


@query(
    "named_companies",
    f"""WITH co AS (SELECT s_suppkey AS company, ([{', '.join(repr(x) for x in _NAMES)}])[1 + s_suppkey % 6] || CASE WHEN s_suppkey % 6 IN (0, 5) THEN ' ' || s_suppkey ELSE '' END AS name FROM supplier),
q AS (SELECT o_orderkey AS question, lower(CASE o_orderkey % 5 WHEN 0 THEN 'Jobs at Olive & Stone?' WHEN 1 THEN 'join fast teams' WHEN 2 THEN 'anything at northwind, or Baker ' || (1 + o_orderkey % 300) || '!' WHEN 3 THEN 'River Works pay' ELSE 'remote work' END) AS text FROM orders),
al AS (SELECT DISTINCT company, alias FROM (SELECT company, unnest(CASE kind WHEN 0 THEN [lower(name)] WHEN 1 THEN ['join', 'northwind'] WHEN 2 THEN ['river works gmbh', 'river works'] WHEN 3 THEN ['fast'] WHEN 4 THEN ['olive stone inc', 'olive stone'] ELSE [lower(name)] END) AS alias FROM (SELECT *, company % 6 AS kind FROM co)) WHERE alias NOT IN ('join', 'fast')),
w AS (SELECT question, ' ' || trim(regexp_replace(text, '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM q), u AS (SELECT DISTINCT t FROM w), hit AS (SELECT DISTINCT t, company FROM u JOIN al ON contains(t, ' ' || alias || ' '))
SELECT question, count(*) AS companies, min(company) AS first FROM w JOIN hit USING (t) GROUP BY 1""",
)
def named_companies(spark: SparkSession, d: str) -> DataFrame:
    """Companies that questions name: by full name, by the name in brackets or without the suffix; never by an ordinary word alone."""
    k, o = F.col("s_suppkey"), F.col("o_orderkey")
    base = F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (k % 6 + 1).cast("int"))
    co = table(spark, d, "supplier").select(k.alias("company"), F.when((k % 6).isin(0, 5), F.concat(base, F.lit(" "), k.cast("string"))).otherwise(base).alias("name"))
    said = F.when(o % 5 == 0, "Jobs at Olive & Stone?").when(o % 5 == 1, "join fast teams").when(o % 5 == 2, F.concat(F.lit("anything at northwind, or Baker "), (o % 300 + 1).cast("string"), F.lit("!"))).when(o % 5 == 3, "River Works pay").otherwise("remote work")
    q = table(spark, d, "orders").select(said.alias("text"), o.alias("question"))
    common = spark.createDataFrame([("join",), ("fast",)], "term string")
    # equal questions are read once
    found = linkage.named_in(q.select("text").distinct(), "text", "text", co, "company", "name", common).groupBy("text").agg(F.count("*").alias("companies"), F.min("company").alias("first"))
    return q.join(found, "text").select("question", "companies", "first")


@query(
    "confirmed_boards",
    r"""WITH c AS (SELECT c_custkey AS board, 'acme' || c_custkey AS slug, CASE WHEN c_custkey % 2 = 0 THEN 'slug' ELSE 'name' END AS why, 'acme' || c_custkey AS squeezed,
CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'acme' || c_custkey || '.com' WHEN 2 THEN 'tryacme' || c_custkey || '.io' WHEN 3 THEN 'acme' || c_custkey || 'power.com' ELSE 'other' || c_custkey || '.org' END AS domain,
CASE WHEN c_custkey % 7 = 0 THEN 'See https://jobs.other' || c_custkey || '.org/x' WHEN c_custkey % 7 = 1 THEN 'at notother' || c_custkey || '.org' ELSE '' END AS text FROM customer)
SELECT board, CASE WHEN domain IS NULL THEN 'no site known' WHEN why = 'slug' AND domain = slug || '.com' THEN 'owns the .com of its slug' WHEN regexp_matches(lower(text), '(^|[^a-z0-9-])' || replace(domain, '.', '\.') || '($|[^a-z0-9-])') THEN 'board points at the site'
WHEN why = 'name' AND (starts_with(squeezed, split_part(domain, '.', 1)) OR split_part(domain, '.', 1) IN (squeezed, 'try' || squeezed)) THEN 'site and name agree' END AS reason FROM c""",
)
def confirmed_boards(spark: SparkSession, d: str) -> DataFrame:
    """Boards of a directory and what confirms them; a namesake's stay unconfirmed."""
    k = F.col("c_custkey")
    key = k.cast("string")
    domain = F.when(k % 5 == 1, F.concat(F.lit("acme"), key, F.lit(".com"))).when(k % 5 == 2, F.concat(F.lit("tryacme"), key, F.lit(".io"))).when(k % 5 == 3, F.concat(F.lit("acme"), key, F.lit("power.com"))).when(k % 5 == 4, F.concat(F.lit("other"), key, F.lit(".org")))
    said = F.when(k % 7 == 0, F.concat(F.lit("See https://jobs.other"), key, F.lit(".org/x"))).when(k % 7 == 1, F.concat(F.lit("at notother"), key, F.lit(".org"))).otherwise("")
    c = table(spark, d, "customer").select(k.alias("board"), F.concat(F.lit("acme"), key).alias("slug"), F.when(k % 2 == 0, "slug").otherwise("name").alias("why"), F.concat(F.lit("Acme "), key).alias("company"), domain.alias("domain"), said.alias("text"))
    return linkage.confirmed(c).select("board", "reason")


# ------------------------------------------------- differences, rounding, answers


def _turn_edits(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before")).where("before IS NOT NULL")
    return t.select("conv_id", "turn", diff.word_edits(F.col("before"), F.col("text")).alias("edits"))


@query("turn_diffs")
def turn_diffs(spark: SparkSession, d: str) -> DataFrame:
    """How the words of each turn differ from the turn before."""
    return _turn_edits(spark, d).select("conv_id", "turn", diff.marked(F.col("edits")).alias("diff"))


_SIDE = "regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


@query(
    "turn_diff_sides",
    f"""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, len({_SIDE.format('before')})::BIGINT AS words_before, len({_SIDE.format('text')})::BIGINT AS words_after, sha256(array_to_string({_SIDE.format('before')}, ' ')) AS sha_before, sha256(array_to_string({_SIDE.format('text')}, ' ')) AS sha_after FROM t WHERE before IS NOT NULL""",
)
def turn_diff_sides(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of each turn's difference rebuilt from it, as digests."""
    e, n = F.col("edits"), {k: diff.words_of(F.col("edits"), k) for k in (diff.KEPT, diff.GONE, diff.CAME)}
    digest = lambda kind: F.sha2(diff.side(e, kind), 256)
    return _turn_edits(spark, d).select(
        "conv_id", "turn", (n[diff.KEPT] + n[diff.GONE]).alias("words_before"), (n[diff.KEPT] + n[diff.CAME]).alias("words_after"), digest(diff.GONE).alias("sha_before"), digest(diff.CAME).alias("sha_after"),
    )


@query(
    "half_precision",
    "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), h AS (SELECT vec_id, x, pow(2.0::DOUBLE, greatest(floor(log2(abs(nullif(x, 0)))), -14) - 10) AS step FROM e) SELECT vec_id, sum(round_even(x / step, 0) * step) AS total FROM h GROUP BY 1",
)
def half_precision(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in half precision; their sums are exact in double, so every engine must agree."""
    return table(spark, d, "embeddings").select("vec_id", F.aggregate(halved(F.col("embedding")), F.lit(0.0), lambda s, x: s + x).alias("total"))


@query(
    "sponsorship_answers",
    f"""WITH {POSTINGS}, m AS (SELECT posting_id, price, lower(body) AS t FROM p WHERE contains(lower(body), 'sponsor')),
c AS (SELECT *, regexp_matches(t, '(unable to|cannot|can not|will not|do not|does not|not able to|no)\\s+(\\w+\\s+){{0,3}}sponsor') AS nay, regexp_matches(t, '(will|can|able to|we)\\s+(\\w+\\s+){{0,2}}sponsor|sponsorship (is )?available|visa sponsorship (is )?(offered|provided)') AS yea FROM m),
k AS (SELECT posting_id, price, CASE WHEN nay AND yea AND regexp_matches(t, 'case[- ]by[- ]case|may ') THEN 'AMBIGUOUS' WHEN nay THEN 'UNAVAILABLE' WHEN yea THEN 'AVAILABLE' ELSE 'UNSTATED' END AS class FROM c)
SELECT class, count(*) AS n, max(price) AS best FROM k GROUP BY 1""",
)
def sponsorship_answers(spark: SparkSession, d: str) -> DataFrame:
    """Postings that mention sponsorship, read and counted by class; only what mentions it is read."""
    m = postings(spark, d).where(F.contains(F.lower("body"), F.lit("sponsor")))
    c = F.coalesce(text.authorization(F.col("body")), F.lit("UNSTATED"))
    return m.groupBy(c.alias("class")).agg(F.count("*").alias("n"), F.max("price").alias("best"))


@query("searchable_text", f"WITH {POSTINGS} SELECT posting_id, md5(concat_ws(' ', title, company, nullif(location, ''), body)) AS digest FROM p")
def searchable_text(spark: SparkSession, d: str) -> DataFrame:
    """The one text that a search reads; what is missing leaves no gap."""
    return postings(spark, d).select("posting_id", F.md5(F.concat_ws(" ", "title", "company", F.nullif("location", F.lit("")), "body")).alias("digest"))


_ASKED = {"data": "data engineers", "software": "software developer jobs", "product": "product managers"}


@query(
    "title_pool",
    f"WITH {POSTINGS}, w AS (SELECT posting_id, string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' ') AS t FROM p) "
    + " UNION ALL ".join(f"SELECT '{k}' AS question, count(*) AS n, min(posting_id) AS first FROM w WHERE {c}" for k, c in (("data", "list_contains(t, 'data') AND (list_contains(t, 'engineer') OR list_contains(t, 'engineers'))"), ("software", "list_contains(t, 'software') AND list_contains(t, 'developer')"), ("product", "list_contains(t, 'product') AND list_contains(t, 'manager')"))),
)
def title_pool(spark: SparkSession, d: str) -> DataFrame:
    """Postings whose title holds the stem of every word of a question, whatever its number; words of every question are left out."""
    stems = lambda c: F.transform(F.filter(linkage.words(c), lambda x: ~x.isin("jobs", "job", "at", "in")), lambda x: F.regexp_replace(x, "s$", ""))
    q = spark.createDataFrame(list(_ASKED.items()), "question string, asked string").select("question", F.array_distinct(stems(F.col("asked"))).alias("want"))
    t = postings(spark, d).select("posting_id", F.explode(F.array_distinct(stems(F.col("title")))).alias("stem"))
    # three questions are joined word by word: a posting is in if it has as many of the words as were asked
    each = q.select("question", F.size("want").alias("all"), F.explode("want").alias("stem"))
    hit = t.join(each, "stem").groupBy("question", "posting_id", "all").agg(F.count("*").alias("have")).where(F.col("have") == F.col("all"))
    return hit.groupBy("question").agg(F.count("*").alias("n"), F.min("posting_id").alias("first"))
