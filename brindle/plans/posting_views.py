"""Readers of postings: places, levels, roles, skills, pay and demands, over postings carved from the part table.

A posting's title, location, lines and address are picked from the lists below by its key, in Spark and in SQL
alike, so that every reader has something to read in every row.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import places, readers, text
from brindle.functions.readers import SKILLS
from brindle.plans.registry import query
from brindle.session import table

PICKS = {
    "level": ["Senior ", "", "Junior ", "Staff ", "", "Principal ", "Sr. ", "Lead "],
    "role": ["Software Engineer", "Data Scientist", "ML Engineer", "Product Manager", "SRE", "Data Engineer", "Software Developer", "Nurse", "Sales Engineer", "Machine Learning Engineer", "Accountant"],
    "tail": ["", " (Remote)", " - Platform", ""],
    "location": [
        "San Francisco, CA", "Remote", "London, UK", "New York, NY", "Toronto, ON, CA", "Austin, TX; San Diego, CA", "Remote - US or Canada", "", "Berlin, Germany", "Los Angeles, California",
        "Newark, NJ", "2 Locations", "Hybrid - Seattle", "Bangalore", "Palo Alto or London", "Tidepool Gomel", "Remote - EMEA", "On-site, Chicago", "Washington / Paris",
    ],
    "intro": ["We build maps.", "This role is remote across the country.", "Remote is not offered for this team.", "We raised $40 million.", "Join us, e.g. as a builder."],
    "head": ["Requirements", "Nice to have:", "About us", "Must have"],
    "first": ["Python or Go", "Kafka required", "Spark and SQL", "Kubernetes a plus", "tools such as Kafka, Spark", "5+ years of experience with Python"],
    "second": ["SQL preferred", "2 years with Kafka", "Python", "at least 3 years of Spark", "Go/Python", "none of these", "K8s", "ideally 7+ years in the field", "minimum SQL"],
    "under": ["Preferred qualifications", "Benefits", "What you need"],
    "third": ["Kafka", "Golang", "10 years in a similar seat", "Spark", "dental plan", "SQL", "4+ years leading teams", "Kubernetes or SQL"],
    "pay": ["Pay: $120,000 - $150,000", "Pay: $120k to $150k", "$45 - $60 an hour", "Salary: £60,000-£75,000", "", "from $90 to 140k", "$5 - $9"],
    "school": ["Bachelor's or Master's degree", "PhD preferred", "high school diploma", "", "MBA a plus", "Associate degree"],
    "visa": ["We will not sponsor visas", "Visa sponsorship available", "", "We can sponsor, case by case, but cannot always sponsor", "unable to sponsor"],
}
LINES = ("intro", "head", "first", "second", "under", "third", "pay", "school", "visa")
#: Each list is walked at an odd pace of its own that shares no factor with its length, so that all of it turns up.
PACE = {name: next(p for p in range(1 + 2 * i, 99, 2) if gcd(p, len(values)) == 1) for i, (name, values) in enumerate(PICKS.items())}


def _pick(name: str, key: Column) -> Column:
    values = PICKS[name]
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(key * PACE[name] / 2) % len(values) + 1).cast("int"))


def _pick_sql(name: str) -> str:
    values = ", ".join("'" + v.replace("'", "''") + "'" for v in PICKS[name])
    return f"([{values}])[(1 + floor(p_partkey * {PACE[name]} / 2.0::DOUBLE)::BIGINT % {len(PICKS[name])})::INT]"


def postings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    title, body = F.concat(*[_pick(x, k) for x in ("level", "role", "tail")]), F.concat_ws("\n", *[_pick(x, k) for x in LINES])
    return p.select(k.alias("posting_id"), F.col("p_brand").alias("company"), title.alias("title"), _pick("location", k).alias("location"), body.alias("body"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


POSTINGS = (
    "p AS (SELECT p_partkey AS posting_id, p_brand AS company, "
    + " || ".join(_pick_sql(x) for x in ("level", "role", "tail"))
    + f" AS title, {_pick_sql('location')} AS location, concat_ws(chr(10), {', '.join(_pick_sql(x) for x in LINES)}) AS body, p_size AS size, p_retailprice AS price FROM part)"
)
_LINES = "l AS (SELECT posting_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM p)"


def _case(col: str, rules: tuple) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}') THEN '{n}'" for n, p in rules) + " END"


_STRENGTH = f"CASE WHEN regexp_matches(lower(line), '{readers.LINE_PREFERRED}') THEN 'preferred' WHEN regexp_matches(lower(line), '{readers.LINE_REQUIRED}') THEN 'required' ELSE coalesce(heading, 'unclassified') END"
_HEADED = (
    f"h AS (SELECT *, {_case('lower(trim(line))', readers.HEADINGS)} AS own FROM l), "
    f"s AS (SELECT posting_id, line, pos, last_value(own IGNORE NULLS) OVER (PARTITION BY posting_id ORDER BY pos) AS heading FROM h QUALIFY own IS NULL), "
    f"st AS (SELECT *, {_STRENGTH} AS strength FROM s)"
)
_OPTION = lambda p: rf"({p}) ?(or\b|/)|(\bor|/) ?({p})|(such as|e\.g\.) [^.;]*({p})"
_SKILLED = "k AS (" + " UNION ALL ".join(
    f"SELECT posting_id, '{k}' AS skill, {i} AS place, CASE strength WHEN 'required' THEN 0 WHEN 'preferred' THEN 1 ELSE 2 END AS weak, regexp_matches(line, '{_OPTION(p)}') AS choice FROM st WHERE regexp_matches(line, '{p}')" for i, (k, p) in enumerate(SKILLS)
) + "), m AS (SELECT posting_id, skill, any_value(place) AS place, min(weak * 2 + choice::INT) AS firm FROM k GROUP BY 1, 2)"
_MENTIONS = f"WITH {POSTINGS}, {_LINES}, {_HEADED}, {_SKILLED}"
_NAMES = ["required", "preferred", "unclassified"]
_NAME_SQL = "(['required', 'preferred', 'unclassified'])[1 + firm // 2]"


def lines(p: DataFrame) -> DataFrame:
    """posting_id, at, line, strength of every line that is no heading; the last heading above a line is carried down to it."""
    l = p.select("posting_id", F.posexplode(F.split("body", "\n")).alias("at", "line"))  # noqa: E741
    w = Window.partitionBy("posting_id").orderBy("at")
    l = l.withColumn("own", readers.heading_kind(F.col("line")))  # noqa: E741
    l = l.withColumn("heading", F.last("own", ignorenulls=True).over(w)).where(F.col("own").isNull())  # noqa: E741
    return l.select("posting_id", "at", "line", readers.line_strength(F.col("line"), F.col("heading")).alias("strength"))


def mentions(p: DataFrame) -> DataFrame:
    """posting_id, skill, place, strength, choice: each skill once a posting, by its firmest line; direct before offered as a choice."""
    weak = F.when(F.col("strength") == "required", 0).when(F.col("strength") == "preferred", 1).otherwise(2)
    found = F.array(*[F.when(F.col("line").rlike(pat), F.struct(F.lit(k).alias("skill"), F.lit(i).alias("place"), readers.is_option(F.col("line"), pat).cast("int").alias("choice"))) for i, (k, pat) in enumerate(SKILLS)])
    k = lines(p).select("posting_id", weak.alias("weak"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("s"))
    m = k.groupBy("posting_id", "s.skill", "s.place").agg(F.min(F.col("weak") * 2 + F.col("s.choice")).alias("firm"))
    names = F.array(*[F.lit(x) for x in _NAMES])
    return m.select("posting_id", "skill", "place", F.element_at(names, F.floor(F.col("firm") / 2).cast("int") + 1).alias("strength"), (F.col("firm") % 2 == 1).alias("choice"))


# ------------------------------------------------- places


@query("locality_classes", f"WITH {POSTINGS} SELECT posting_id, location, {places.locality_sql('location')} AS locality FROM p")
def locality_classes(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("posting_id", "location", places.locality(F.col("location")).alias("locality"))


_OFFICES = "o AS (SELECT *, list_filter(list_transform(regexp_split_to_array(location, ' ?[;|/] ?| or '), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+ [Ll]ocations?$')) AS offices FROM p)"


@query("location_offices", f"WITH {POSTINGS}, {_OFFICES} SELECT posting_id, unnest(offices) AS office FROM o")
def location_offices(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("posting_id", F.explode(places.offices(F.col("location"))).alias("office"))


_META = f"lower(title || ' ' || location)"  # noqa: F541
_REMOTE = f"coalesce(CASE WHEN regexp_matches({_META}, '{places.DENIED}') THEN false WHEN regexp_matches({_META}, '{places.REMOTE}') THEN true WHEN regexp_matches({_META}, '{places.ONSITE}') THEN false END, regexp_matches(lower(body), '{places.REMOTE}') AND NOT regexp_matches(lower(body), '{places.DENIED}'))"


def _remote() -> Column:
    return places.reads_as_remote(F.col("title"), F.col("location"), F.col("body"))


@query("remote_postings", f"WITH {POSTINGS} SELECT posting_id, {_REMOTE} AS remote FROM p")
def remote_postings(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("posting_id", _remote().alias("remote"))


@query(
    "location_predicate",
    f"WITH {POSTINGS}, c AS (SELECT *, {places.locality_sql('location')} AS locality FROM p) SELECT posting_id, regexp_matches(lower(location), '\\b(california|ca)\\b') AND locality <> 'elsewhere' AS in_ca, regexp_matches(lower(location), '\\b(united kingdom|england|uk)\\b') AS in_uk FROM c",
)
def location_predicate(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("posting_id", places.mentions_place(F.col("location"), "CA").alias("in_ca"), places.mentions_place(F.col("location"), "UK").alias("in_uk"))


@query(
    "search_area",
    f"""WITH {POSTINGS}, {_OFFICES}, r AS (SELECT posting_id, offices, {_REMOTE} AS remote FROM o), e AS (SELECT posting_id, remote, unnest(offices) AS office FROM r),
b AS (SELECT posting_id, bool_or({places.locality_sql('office')} IN ('bay_area', 'california', 'unknown') OR ({places.locality_sql('office')} = 'united_states' AND remote)) AS hit FROM e GROUP BY 1)
SELECT r.posting_id, coalesce(hit, true) AS reachable FROM r LEFT JOIN b ON r.posting_id = b.posting_id""",
)
def search_area(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("posting_id", places.in_area(F.col("location"), _remote()).alias("reachable"))


_RANKED = "CASE " + " ".join(f"WHEN locality = '{k}' THEN {v}" for k, v in places.RANKS.items()) + " END"


@query(
    "locality_then_score",
    f"WITH {POSTINGS}, c AS (SELECT *, {places.locality_sql('location')} AS locality FROM p) SELECT posting_id, locality, place FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY {_RANKED}, price DESC, posting_id) AS place FROM c) WHERE place <= 20",
)
def locality_then_score(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d).withColumn("locality", places.locality(F.col("location")))
    w = Window.partitionBy("company").orderBy(places.locality_rank(F.col("locality")), F.col("price").desc(), "posting_id")
    return p.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 20").select("posting_id", "locality", "place")


@query("metadata_collapse", f"WITH {POSTINGS}, g AS (SELECT location, count(*) AS n FROM p GROUP BY 1) SELECT {places.locality_sql('location')} AS locality, sum(n)::BIGINT AS postings, count(*) AS spellings FROM g GROUP BY 1")
def metadata_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Equal metadata is classified once, however many postings carry it."""
    g = postings(spark, d).groupBy("location").agg(F.count("*").alias("n"))
    return g.groupBy(places.locality(F.col("location")).alias("locality")).agg(F.sum("n").alias("postings"), F.count("*").alias("spellings"))


# ------------------------------------------------- titles


def _role_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(' ' || {x} || ' ', ' {a} ') THEN '{r}'" for a, r in readers.ROLES) + " END"


_SURFACE = r"trim(regexp_replace(regexp_replace(lower(title), '\([^)]*\)| - .*$', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_PLAIN = f"trim(regexp_replace(regexp_replace(t, '{readers.LEVEL_WORDS}', ' ', 'g'), ' +', ' ', 'g'))"


@query("role_lookup", f"WITH {POSTINGS}, n AS (SELECT posting_id, {_SURFACE} AS t FROM p) SELECT posting_id, coalesce({_role_sql('t')}, {_role_sql(_PLAIN)}) AS role FROM n")
def role_lookup(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("posting_id", readers.role_of(F.col("title")).alias("role"))


@query("title_groups", f"WITH {POSTINGS} SELECT title_group, count(*) AS n FROM (SELECT nullif({_case('lower(title)', readers.GROUPS)}, 'not_it') AS title_group FROM p) GROUP BY 1")
def title_groups(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).groupBy(readers.title_group(F.col("title")).alias("title_group")).agg(F.count("*").alias("n"))


_RUNG = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN {k}" for k, (_, p) in enumerate(text.RUNGS)) + " END"


_RUNG_NAMES = ", ".join(f"'{n}'" for n, _ in text.RUNGS)


@query("seniority_rungs", f"WITH {POSTINGS}, r AS (SELECT {_RUNG} AS rung FROM p) SELECT coalesce(([{_RUNG_NAMES}])[rung + 1], 'none') AS level, count(*) AS n FROM r GROUP BY 1")
def seniority_rungs(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n, _ in text.RUNGS])
    level = F.coalesce(F.get(names, text.rung(F.col("title"))), F.lit("none"))
    return postings(spark, d).groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query("seniority_filters", f"WITH {POSTINGS}, r AS (SELECT posting_id, {_RUNG} AS rung FROM p) SELECT posting_id, coalesce(abs(rung - 3) <= 1, true) AS near_senior, coalesce(rung BETWEEN 1 AND 3, false) AS junior_to_senior FROM r")
def seniority_filters(spark: SparkSession, d: str) -> DataFrame:
    """Distance to a target rung (unstated passes), and a range of rungs (unknown drops)."""
    r = text.rung(F.col("title"))
    return postings(spark, d).select("posting_id", F.coalesce(F.abs(r - 3) <= 1, F.lit(True)).alias("near_senior"), F.coalesce(r.between(1, 3), F.lit(False)).alias("junior_to_senior"))


@query("level_standing", f"WITH {POSTINGS}, r AS (SELECT CASE WHEN {_RUNG} IS NULL THEN 2 WHEN {_RUNG} <> 3 THEN 3 WHEN regexp_matches(lower(title), '\\bsenior\\b') THEN 0 ELSE 1 END AS standing FROM p) SELECT standing, count(*) AS n FROM r GROUP BY 1")
def level_standing(spark: SparkSession, d: str) -> DataFrame:
    """How titles stand to "senior": 0 says the word, 1 is on the rung, 2 names no level, 3 names another."""
    r = text.rung(F.col("title"))
    standing = F.when(r.isNull(), 2).when(r != 3, 3).when(F.lower("title").rlike(r"\bsenior\b"), 0).otherwise(1)
    return postings(spark, d).groupBy(standing.alias("standing")).agg(F.count("*").alias("n"))


_WORDS = "list_transform(regexp_extract_all(lower(regexp_replace(title, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+'), lambda w: CASE " + " ".join(f"WHEN w = '{k}' THEN '{v}'" for k, v in text.TITLE_WORDS.items()) + " ELSE w END)"


@query("title_keys", f"WITH {POSTINGS} SELECT posting_id, substr(array_to_string(list_sort(list_distinct(string_split(array_to_string({_WORDS}, ' '), ' '))), ' '), 1, 300) AS title_key FROM p")
def title_keys(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("posting_id", text.title_key(F.col("title")).alias("title_key"))


# ------------------------------------------------- skills and demands


@query("skill_mentions", f"{_MENTIONS} SELECT posting_id, skill, {_NAME_SQL} AS strength, firm % 2 = 1 AS choice FROM m")
def skill_mentions(spark: SparkSession, d: str) -> DataFrame:
    return mentions(postings(spark, d)).select("posting_id", "skill", "strength", "choice")


@query("skill_demand_classes", f"{_MENTIONS} SELECT skill, count(*) FILTER (firm = 0) AS required, count(*) FILTER (firm = 1) AS options, count(*) FILTER (firm IN (2, 3)) AS preferred, count(*) FILTER (firm > 3) AS named FROM m GROUP BY 1")
def skill_demand_classes(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(postings(spark, d))
    n = lambda c: F.count_if(c)
    s, choice = F.col("strength"), F.col("choice")
    return m.groupBy("skill").agg(n((s == "required") & ~choice).alias("required"), n((s == "required") & choice).alias("options"), n(s == "preferred").alias("preferred"), n(s == "unclassified").alias("named"))


@query("requirement_buckets", f"{_MENTIONS} SELECT posting_id, " + ", ".join(f"coalesce(string_agg(skill, ',' ORDER BY place) FILTER (firm // 2 = {i}), '') AS {n}" for i, n in enumerate(_NAMES)) + " FROM m GROUP BY 1")
def requirement_buckets(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(postings(spark, d)).groupBy("posting_id").agg(F.array_sort(F.collect_list(F.struct("place", "skill", "strength"))).alias("s"))
    pick = lambda n: F.array_join(F.transform(F.filter("s", lambda x: x["strength"] == n), lambda x: x["skill"]), ",")
    return m.select("posting_id", *[pick(n).alias(n) for n in _NAMES])


_PAY = r"([$€£])\s?([0-9][0-9,.]*)\s?([kK]?)\s?(?:-|–|to)\s?[$€£]?\s?([0-9][0-9,.]*)\s?([kK]?)"
_AMOUNT = lambda g, k: f"(CASE WHEN (lower(x[{k}]) = 'k' OR lower(x[5]) = 'k') AND TRY_CAST(regexp_replace(replace(x[{g}], ',', ''), '\\.$', '') AS DOUBLE) < 1000 THEN TRY_CAST(regexp_replace(replace(x[{g}], ',', ''), '\\.$', '') AS DOUBLE) * 1000 ELSE TRY_CAST(regexp_replace(replace(x[{g}], ',', ''), '\\.$', '') AS DOUBLE) END)"
_PAID = f"""x AS (SELECT posting_id, [regexp_extract(body, '{_PAY}', 1), regexp_extract(body, '{_PAY}', 2), regexp_extract(body, '{_PAY}', 3), regexp_extract(body, '{_PAY}', 4), regexp_extract(body, '{_PAY}', 5)] AS x FROM p),
y AS (SELECT posting_id, {_AMOUNT(2, 3)} AS low, {_AMOUNT(4, 5)} AS high, CASE x[1] WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' END AS currency FROM x),
z AS (SELECT posting_id, low, high, currency, CASE WHEN high < 500 THEN 'hour' ELSE 'year' END AS period FROM y WHERE low <= high AND CASE WHEN high < 500 THEN low > 0 ELSE low >= 10000 AND high <= 2000000 END)"""


@query("pay_ranges", f"WITH {POSTINGS}, {_PAID} SELECT posting_id, low, high, currency, period, CASE WHEN period = 'year' AND high < 100000 THEN 'BELOW' WHEN period = 'year' AND low > 130000 THEN 'ABOVE' WHEN period = 'year' THEN 'WITHIN' ELSE 'UNKNOWN' END AS against FROM z")
def pay_ranges(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d).select("posting_id", text.pay_range(F.col("body")).alias("pay")).where(F.col("pay").isNotNull())
    return p.select("posting_id", "pay.*", text.compare_pay(F.col("pay"), 100_000, 130_000).alias("against"))


_YEARS = r"\b([0-9]{1,2})\s*\+?\s*(?:-\s*[0-9]{1,2}\s*)?(?:years?|yrs?)\b"


@query("years_demands", f"{'WITH ' + POSTINGS + ', ' + _LINES + ', ' + _HEADED}, y AS (SELECT posting_id, regexp_extract(line, '{_YEARS}', 1)::INT AS years, CASE strength WHEN 'required' THEN 'mandatory' WHEN 'preferred' THEN 'preferred' ELSE 'ambiguous' END AS kind FROM st WHERE regexp_matches(line, '{_YEARS}')) SELECT posting_id, count(*) AS demands, min(years) FILTER (kind = 'mandatory') AS least, coalesce(min(years) FILTER (kind = 'mandatory') <= 4, true) AS within_four FROM y GROUP BY 1")
def years_demands(spark: SparkSession, d: str) -> DataFrame:
    """Years that lines ask for, mandatory by their own words or the heading above; only mandatory minimums exclude."""
    l = lines(postings(spark, d)).where(F.col("line").rlike(_YEARS))  # noqa: E741
    y = l.select("posting_id", F.regexp_extract("line", _YEARS, 1).cast("int").alias("years"), (F.col("strength") == "required").alias("must"))
    least = F.min(F.when(F.col("must"), F.col("years")))
    return y.groupBy("posting_id").agg(F.count("*").alias("demands"), least.alias("least"), F.coalesce(least <= 4, F.lit(True)).alias("within_four"))


_SCHOOL = "CASE " + " ".join(f"WHEN regexp_matches(lower(body), '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in text.EDUCATION) + " END"


@query("education_levels", f"WITH {POSTINGS} SELECT posting_id, {_SCHOOL} AS education FROM p")
def education_levels(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("posting_id", text.least_education(F.col("body")).alias("education"))


_NO = r"(unable to|cannot|can not|will not|do not|does not|not able to|no)\s+(\w+\s+){0,3}sponsor"
_YES = r"(will|can|able to|we)\s+(\w+\s+){0,2}sponsor|sponsorship (is )?available|visa sponsorship (is )?(offered|provided)"
_VISA = f"CASE WHEN regexp_matches(lower(body), '{_NO}') AND regexp_matches(lower(body), '{_YES}') AND regexp_matches(lower(body), 'case[- ]by[- ]case|may ') THEN 'AMBIGUOUS' WHEN regexp_matches(lower(body), '{_NO}') THEN 'UNAVAILABLE' WHEN regexp_matches(lower(body), '{_YES}') THEN 'AVAILABLE' END"


@query("authorization_classes", f"WITH {POSTINGS} SELECT coalesce({_VISA}, 'UNSTATED') AS sponsorship, count(*) AS n, min(posting_id) AS first_posting FROM p GROUP BY 1")
def authorization_classes(spark: SparkSession, d: str) -> DataFrame:
    a = F.coalesce(text.authorization(F.col("body")), F.lit("UNSTATED"))
    return postings(spark, d).groupBy(a.alias("sponsorship")).agg(F.count("*").alias("n"), F.min("posting_id").alias("first_posting"))


@query(
    "requirement_unknowns",
    f"""{_MENTIONS}, {_PAID}, q AS (SELECT p.posting_id, z.posting_id IS NULL AS pay, k2.posting_id IS NULL AS sk, {_SCHOOL} IS NULL AS ed FROM p LEFT JOIN z ON p.posting_id = z.posting_id LEFT JOIN (SELECT DISTINCT posting_id FROM m) k2 ON p.posting_id = k2.posting_id)
SELECT posting_id, array_to_string(list_filter([CASE WHEN pay THEN 'compensation' END, CASE WHEN sk THEN 'skills' END, CASE WHEN ed THEN 'education' END], lambda x: x IS NOT NULL), ',') AS missing FROM q""",
)
def requirement_unknowns(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d)
    some = mentions(p).select("posting_id", F.lit(True).alias("has")).distinct()
    miss = F.array(F.when(text.pay_range(F.col("body")).isNull(), "compensation"), F.when(F.col("has").isNull(), "skills"), F.when(text.least_education(F.col("body")).isNull(), "education"))
    return p.join(some, "posting_id", "left").select("posting_id", F.array_join(miss, ",").alias("missing"))


@query(
    "structured_requirements",
    f"""{_MENTIONS}, {_PAID}, w AS (SELECT posting_id, bool_or(skill = 'python') AS wanted, bool_or(skill = 'kubernetes' AND firm // 2 = 0) AS lacking FROM m GROUP BY 1),
q AS (SELECT p.posting_id, coalesce(CASE WHEN period = 'year' THEN high END < 140000, false) AS low, coalesce(NOT wanted, false) AS unwanted, coalesce(lacking, false) AS lacking, coalesce({_SCHOOL} IN ('master', 'doctorate'), false) AS school FROM p LEFT JOIN z ON p.posting_id = z.posting_id LEFT JOIN w ON p.posting_id = w.posting_id)
SELECT posting_id, array_to_string(list_filter([CASE WHEN low THEN 'salary' END, CASE WHEN unwanted THEN 'wanted_skills' END, CASE WHEN lacking THEN 'lacking_skills' END, CASE WHEN school THEN 'education' END], lambda x: x IS NOT NULL), ',') AS reasons FROM q""",
)
def structured_requirements(spark: SparkSession, d: str) -> DataFrame:
    """Reasons against a posting: pay out of reach, no wanted skill, a required skill one lacks, too much schooling; unknown passes."""
    p = postings(spark, d)
    w = mentions(p).groupBy("posting_id").agg(F.bool_or(F.col("skill") == "python").alias("wanted"), F.bool_or((F.col("skill") == "kubernetes") & (F.col("strength") == "required")).alias("lacking"))
    pay = text.pay_range(F.col("body"))
    checks = [F.when((pay["period"] == "year") & (pay["high"] < 140_000), "salary"), F.when(~F.col("wanted"), "wanted_skills"), F.when(F.col("lacking"), "lacking_skills"), F.when(text.least_education(F.col("body")).isin("master", "doctorate"), "education")]
    return p.join(w, "posting_id", "left").select("posting_id", F.array_join(F.array(*checks), ",").alias("reasons"))


_KEYWORDS = {"kafka": ("kafka",), "software engineer": ("software", "engineer"), "python spark": ("python", "spark")}


def _phrase(words: tuple[str, ...]) -> str:
    return r"\b" + r"[^a-z0-9]+".join(f"{w}(e?s)?" for w in words) + r"\b"


def _near(words: tuple[str, ...], gap: int = 8) -> str:
    if len(words) != 2:
        return _phrase(words)
    a, b = (f"{w}(e?s)?" for w in words)
    between = rf"[^a-z0-9]+([a-z0-9+#.]+[^a-z0-9]+){{0,{gap}}}"
    return rf"\b({a}{between}{b}|{b}{between}{a})\b"


@query(
    "keyword_find",
    f"WITH {POSTINGS} " + " UNION ALL ".join(f"SELECT posting_id, '{k}' AS keyword, CASE WHEN regexp_matches(lower(title), '{_phrase(w)}') THEN 'title' WHEN regexp_matches(lower(body), '{_phrase(w)}') THEN 'phrase' WHEN regexp_matches(lower(body), '{_near(w)}') THEN 'near' END AS found FROM p WHERE regexp_matches(lower(title), '{_phrase(w)}') OR regexp_matches(lower(body), '{_near(w)}')" for k, w in _KEYWORDS.items()),
)
def keyword_find(spark: SparkSession, d: str) -> DataFrame:
    """Where a keyword stands: whole words with plurals in the title, as a phrase in the body, or with few words between."""
    p = postings(spark, d)
    t, b = F.lower("title"), F.lower("body")
    one = lambda k, w: F.when(t.rlike(_phrase(w)), F.struct(F.lit(k), F.lit("title"))).when(b.rlike(_phrase(w)), F.struct(F.lit(k), F.lit("phrase"))).when(b.rlike(_near(w)), F.struct(F.lit(k), F.lit("near")))
    found = F.filter(F.array(*[one(k, w).cast("struct<keyword:string,found:string>") for k, w in _KEYWORDS.items()]), lambda x: x.isNotNull())
    return p.select("posting_id", F.explode(found).alias("f")).select("posting_id", "f.*")


@query(
    "regex_prefilter_scores",
    f"WITH {POSTINGS}, f AS (SELECT posting_id, lower(concat_ws(' ', title, location, body)) AS t FROM p WHERE regexp_matches(lower(concat_ws(' ', title, location, body)), '\\b(kafka|spark|remote)\\b')) SELECT posting_id, (CASE WHEN regexp_matches(t, '\\bkafka\\b') THEN 3.0 ELSE 0 END + CASE WHEN regexp_matches(t, '\\bspark\\b') THEN 2.5 ELSE 0 END + CASE WHEN regexp_matches(t, '\\bremote\\b') THEN 1.0 ELSE 0 END)::DOUBLE AS score FROM f",
)
def regex_prefilter_scores(spark: SparkSession, d: str) -> DataFrame:
    """One combined pattern keeps what any term can score, then each term adds its weight."""
    weights = {"kafka": 3.0, "spark": 2.5, "remote": 1.0}
    f = postings(spark, d).select("posting_id", F.lower(F.concat_ws(" ", "title", "location", "body")).alias("t")).where(F.col("t").rlike(r"\b(" + "|".join(weights) + r")\b"))
    total = sum((F.when(F.col("t").rlike(rf"\b{k}\b"), v).otherwise(0.0) for k, v in weights.items()), F.lit(0.0))
    return f.select("posting_id", total.alias("score"))


@query("required_skill_search", f"{_MENTIONS}, q AS (SELECT posting_id, firm FROM m WHERE skill = 'kafka') SELECT posting_id, firm, (count(*) OVER ())::BIGINT AS total FROM q QUALIFY row_number() OVER (ORDER BY firm, posting_id DESC) <= 50")
def required_skill_search(spark: SparkSession, d: str) -> DataFrame:
    """Postings that name a skill, those that require it first; the total counts all of them."""
    m = mentions(postings(spark, d)).where("skill = 'kafka'")
    firm = F.when(F.col("strength") == "required", 0).when(F.col("strength") == "preferred", 2).otherwise(4) + F.col("choice").cast("int")
    m = m.select("posting_id", firm.alias("firm"))
    return m.orderBy("firm", F.col("posting_id").desc()).limit(50).crossJoin(F.broadcast(m.agg(F.count("*").alias("total"))))  # one row


# ------------------------------------------------- addresses, digests, small readers


_URL = "(['https://boards.greenhouse.io/', 'https://jobs.lever.co/', 'https://example.org/careers/', 'https://apply.workable.com/', 'https://jobs.ashbyhq.com/'])[(1 + s_suppkey % 5)::INT] || 'co-' || s_suppkey || '/j/1'"
_BARE = r"trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))"


@query("board_urls", "WITH u AS (SELECT s_suppkey, " + _URL + " AS url FROM supplier) SELECT s_suppkey, " + "CASE " + " ".join(f"WHEN regexp_matches(lower(url), '{p}') THEN '{n}'" for n, p in readers.BOARDS) + " END AS ats, CASE " + " ".join(f"WHEN regexp_matches(lower(url), '{p}') THEN regexp_extract(lower(url), '{p}', 1)" for _, p in readers.BOARDS) + " END AS slug FROM u")
def board_urls(spark: SparkSession, d: str) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(x) for x in ("https://boards.greenhouse.io/", "https://jobs.lever.co/", "https://example.org/careers/", "https://apply.workable.com/", "https://jobs.ashbyhq.com/")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    b = readers.board_of(F.concat(head, F.lit("co-"), F.col("s_suppkey"), F.lit("/j/1")))
    return table(spark, d, "supplier").select("s_suppkey", b["ats"].alias("ats"), b["slug"].alias("slug"))


@query(
    "slug_candidates",
    f"""WITH n AS (SELECT n_nationkey, n_name || ' Maps, Inc.' AS name FROM nation), a AS (SELECT n_nationkey, {_BARE} AS low, trim(regexp_replace({_BARE}, '\\b(inc|llc|ltd|gmbh|corp|co)\\b', ' ', 'g')) AS bare FROM n),
c AS (SELECT n_nationkey, [replace(bare, ' ', ''), replace(bare, ' ', '-'), replace(low, ' ', ''), string_split(bare, ' ')[1]] AS all4 FROM a), e AS (SELECT n_nationkey, unnest(all4) AS slug, generate_subscripts(all4, 1) AS pos FROM c)
SELECT n_nationkey, string_agg(slug, ',' ORDER BY first_at) AS slugs FROM (SELECT n_nationkey, slug, min(pos) AS first_at FROM e WHERE slug <> '' GROUP BY 1, 2) GROUP BY 1""",
)
def slug_candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.array_join(readers.slug_candidates(F.concat("n_name", F.lit(" Maps, Inc."))), ",").alias("slugs"))


@query("liveness_classes", f"WITH r AS (SELECT o_orderkey, ([200, 404, 200, 503, 410, 200])[(1 + o_orderkey % 6)::INT] AS status, CASE WHEN o_orderstatus = 'F' THEN 'This position has been filled.' ELSE 'Apply now' END AS body FROM orders) SELECT CASE WHEN status IN (404, 410) OR (status = 200 AND regexp_matches(lower(body), '{readers.CLOSED}')) THEN 'closed' WHEN status = 200 THEN 'open' ELSE 'unknown' END AS liveness, count(*) AS n FROM r GROUP BY 1")
def liveness_classes(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 404, 200, 503, 410, 200)]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    body = F.when(F.col("o_orderstatus") == "F", "This position has been filled.").otherwise("Apply now")
    return table(spark, d, "orders").groupBy(readers.liveness(status, body).alias("liveness")).agg(F.count("*").alias("n"))


_STEM = "CASE " + " ".join(f"WHEN regexp_matches(w, '^.{{3,}}{s}$') THEN regexp_replace(w, '{s}$', '{r}')" for s, r in readers.SUFFIXES) + " ELSE w END"


@query("light_stems", f"WITH t AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS w FROM benchmark) SELECT {_STEM} AS stem, count(*) AS n, count(DISTINCT w) AS forms FROM t GROUP BY 1")
def light_stems(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return w.groupBy(readers.light_stem(F.col("w")).alias("stem")).agg(F.count("*").alias("n"), F.count_distinct("w").alias("forms"))


_FIG = f"list_sort(list_distinct(list_transform(regexp_extract_all(body, '{readers.FIGURE}'), lambda x: replace(x, ',', ''))))"


@query("figures_lost", f"WITH {POSTINGS}, f AS (SELECT posting_id, {_FIG} AS every, {_FIG.replace('body', 'substr(body, 1, 80)')} AS kept FROM p) SELECT posting_id, array_to_string(every, ' ') AS figures, array_to_string(list_filter(every, lambda x: NOT list_contains(kept, x)), ' ') AS lost FROM f")
def figures_lost(spark: SparkSession, d: str) -> DataFrame:
    """Figures of a text, and those that its first lines no longer hold."""
    p = postings(spark, d).select("posting_id", readers.figures(F.col("body")).alias("every"), readers.figures(F.substring("body", 1, 80)).alias("kept"))
    return p.select("posting_id", F.array_join("every", " ").alias("figures"), F.array_join(F.filter("every", lambda x: ~F.array_contains("kept", x)), " ").alias("lost"))


@query("masked_contacts", "WITH f AS (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}')) AS e FROM documents) SELECT doc_id, len(e)::BIGINT AS emails, true AS restored, true AS clean FROM f WHERE len(e) > 0")
def masked_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Contacts leave no text unmasked, and come back as they were."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out, contacts = readers.masked(F.col("text"))
    m = docs.select("doc_id", "text", out.alias("out"), contacts.alias("contacts")).where(F.size("contacts.EMAIL") > 0)
    clean = ~F.col("out").rlike(readers.MASKED[0][1])
    return m.select("doc_id", F.size("contacts.EMAIL").cast("long").alias("emails"), (readers.unmasked(F.col("out"), F.col("contacts")) == F.col("text")).alias("restored"), clean.alias("clean"))


@query("proper_nouns", f"WITH {POSTINGS}, w AS (SELECT posting_id, list_distinct(regexp_extract_all(body, '\\b[A-Za-z][a-z]{{2,}}\\b')) AS w FROM p) SELECT posting_id, array_to_string(list_sort(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]') AND NOT list_contains(w, lower(x)))), ' ') AS names FROM w")
def proper_nouns(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("posting_id", F.array_join(readers.proper_nouns(F.col("body")), " ").alias("names"))


@query("quote_clips", f"WITH {POSTINGS} SELECT posting_id, CASE WHEN length(body) > 60 THEN rtrim(substr(body, 1, 57), ' ') || '...' ELSE body END AS quote FROM p")
def quote_clips(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("posting_id", text.clipped(F.col("body"), 60).alias("quote"))


@query("one_time_codes", "WITH m AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'Your code is ' || (100000 + conv_id) WHEN 1 THEN 'PIN: 12' ELSE 'order ' || (5000 + turn) END AS t FROM conversations) SELECT conv_id, turn, regexp_extract(lower(t), '(?:code|otp|pin)\\D{0,20}([0-9]{4,8})(?:[^0-9]|$)', 1) AS code FROM m WHERE regexp_matches(lower(t), '(?:code|otp|pin)\\D{0,20}([0-9]{4,8})(?:[^0-9]|$)')")
def one_time_codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("conv_id") % 3
    t = F.when(k == 0, F.concat(F.lit("Your code is "), F.lit(100000) + F.col("conv_id"))).when(k == 1, "PIN: 12").otherwise(F.concat(F.lit("order "), F.lit(5000) + F.col("turn")))
    return table(spark, d, "conversations").select("conv_id", "turn", text.one_time_code(t).alias("code")).where(F.col("code").isNotNull())


@query("parsed_times", "WITH r AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN (epoch(o_orderdate)::BIGINT)::VARCHAR WHEN 2 THEN (epoch(o_orderdate)::BIGINT * 1000)::VARCHAR ELSE 'soon' END AS raw FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN epoch(o_orderdate)::BIGINT END AS at FROM r")
def parsed_times(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("timestamp")
    raw = F.when(k == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.unix_timestamp(at).cast("string")).when(k == 2, (F.unix_timestamp(at) * 1000).cast("string")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", F.unix_timestamp(text.parsed_time(raw)).alias("at"))


@query("content_hashes", f"WITH {POSTINGS} SELECT posting_id, sha256(concat_ws(chr(31), title, coalesce(location, ''), body)) AS digest, '{{\"company\":\"' || company || '\",\"size\":' || size || ',\"title\":\"' || title || '\"}}' AS encoded FROM p")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the fields in a fixed order, and the record as JSON with sorted keys."""
    return postings(spark, d).select("posting_id", text.content_hash(F.col("title"), F.col("location"), F.col("body")).alias("digest"), F.to_json(F.struct("company", "size", "title")).alias("encoded"))


@query("posting_changes", f"WITH {POSTINGS} SELECT posting_id, array_to_string(list_filter([CASE WHEN size % 5 = 0 THEN 'title' END, CASE WHEN size % 7 = 0 AND location <> 'Remote' THEN 'location' END, CASE WHEN size % 11 = 0 THEN 'body' END], lambda x: x IS NOT NULL), ',') AS changed FROM p WHERE size % 5 = 0 OR (size % 7 = 0 AND location <> 'Remote') OR size % 11 = 0")
def posting_changes(spark: SparkSession, d: str) -> DataFrame:
    """Fields that a second reading of a posting has changed."""
    old = postings(spark, d)
    new = old.select(
        "posting_id",
        F.when(F.col("size") % 5 == 0, F.concat("title", F.lit(" II"))).otherwise(F.col("title")).alias("title2"),
        F.when(F.col("size") % 7 == 0, "Remote").otherwise(F.col("location")).alias("location2"),
        F.when(F.col("size") % 11 == 0, F.lit(None)).otherwise(F.col("body")).alias("body2"),
    )
    both = old.join(new, "posting_id")
    names = ("title", "location", "body")
    c = readers.changed_fields({n: F.col(n) for n in names}, {n: F.col(n + "2") for n in names})
    return both.select("posting_id", F.array_join(c, ",").alias("changed")).where("changed <> ''")


@query("lag_hours", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN round(greatest(epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate), 0) / 3600.0::DOUBLE, 2) END AS lag FROM orders")
def lag_hours(spark: SparkSession, d: str) -> DataFrame:
    """Hours from publication to first sight, never below 0; unknown without a publication."""
    seconds = F.unix_timestamp(F.lit("1998-01-01").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.round(F.greatest(seconds, F.lit(0)) / 3600.0, 2)).alias("lag"))


@query("legitimacy_tiers", f"WITH {POSTINGS}, t AS (SELECT *, count(*) OVER (PARTITION BY company, title, body) AS twins FROM p), s AS (SELECT posting_id, (size > 40)::INT + (length(body) < 150)::INT + (twins > 1)::INT AS doubts FROM t) SELECT CASE WHEN doubts = 0 THEN 'HIGH' WHEN doubts = 1 THEN 'CAUTION' ELSE 'SUSPICIOUS' END AS tier, count(*) AS n FROM s GROUP BY 1")
def legitimacy_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Doubts add up: an old posting (size as its age), a thin body, twins under one company. Twins meet by digest, counted before they are joined back."""
    p = postings(spark, d).withColumn("k", F.sha2(F.concat_ws("\x1f", "company", "title", "body"), 256))
    twins = p.groupBy("k").agg(F.count("*").alias("twins"))
    doubts = (F.col("size") > 40).cast("int") + (F.length("body") < 150).cast("int") + (F.col("twins") > 1).cast("int")
    tier = F.when(doubts == 0, "HIGH").when(doubts == 1, "CAUTION").otherwise("SUSPICIOUS")
    return p.join(twins, "k").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))
