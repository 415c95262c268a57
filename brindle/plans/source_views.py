"""Readers and sinks: board payloads, feeds, sheets, mail, journals, vectors and metrics text, each fed from the driver tables.

Payloads are carved out of the postings, fifty to a page, so that no page grows with its company.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.plans.posting_views import POSTINGS, postings
from brindle.plans.registry import query
from brindle.session import shared_dir, table, written_files
from brindle.sources import boards, files, mail, paged

PAGE = 50


def _id() -> Column:
    return F.col("posting_id")


def _key() -> Column:
    return _id().cast("string")


def _title() -> Column:
    return F.col("title")


def _place() -> Column:
    return F.col("location")


def _body() -> Column:
    return F.col("body")


def _html() -> Column:
    return F.concat(F.lit("<div>"), F.replace(_body(), F.lit("\n"), F.lit("<br>")), F.lit("</div><!-- end -->"))


def _day() -> Column:
    """Every posting dates from a day of its own within 400 days."""
    return F.date_add(F.lit("2024-01-01").cast("date"), (_id() % 400).cast("int"))


def _remote() -> Column:
    return F.array(F.struct(F.lit("Remote").alias("name")))


def _pages(spark: SparkSession, d: str, job: Column, wrap) -> DataFrame:
    """company, body: a page of jobs as JSON, wrapped as a board wraps it."""
    p = postings(spark, d).withColumn("page", F.floor(_id() / PAGE)).select("company", "page", job.alias("job"))
    g = p.groupBy("company", "page").agg(F.sort_array(F.collect_list("job")).alias("jobs"))
    return g.select("company", wrap(F.col("jobs")).alias("body"))


def _under(name: str):
    return lambda jobs: F.to_json(F.struct(jobs.alias(name)))


def _fields(**cols: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in cols.items()])


def _text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def _millis(day: Column) -> Column:
    return F.unix_timestamp(day.cast("timestamp")) * 1000


#: What a board tells beside title and place: more places, body, date.
TELLS = {"greenhouse": "bd", "lever": "mbd", "ashby": "mbd", "workable": "bd", "breezy": "md", "oracle": "md", "icims": "bd", "remotive": "bd", "arbeitnow": "bd", "remoteok": "b"}


def _shapes() -> dict:
    """Each board's reader, a job as it writes it, and how a page wraps its jobs."""
    return {
        "greenhouse": (boards.greenhouse, _fields(id=_id(), title=_title(), location=F.struct(_place().alias("name")), content=_html(), first_published=_text(_day())), _under("jobs")),
        "lever": (boards.lever, _fields(id=_key(), text=_title(), categories=F.struct(_place().alias("location"), F.array(F.lit("Remote")).alias("allLocations")), description=_html(), createdAt=_millis(_day())), F.to_json),
        "ashby": (boards.ashby, _fields(id=_key(), title=_title(), location=_place(), secondaryLocations=F.array(F.struct(F.lit("Remote").alias("location"))), descriptionHtml=_html(), publishedAt=_text(_day())), _under("jobs")),
        "workable": (boards.workable, _fields(shortcode=_key(), title=_title(), city=_place(), description=_html(), published_on=_text(_day())), _under("jobs")),
        "breezy": (boards.breezy, _fields(id=_key(), name=_title(), location=F.struct(_place().alias("name")), locations=_remote(), published_date=_text(_day())), F.to_json),
        "oracle": (boards.oracle, _fields(Id=_key(), Title=_title(), PostedDate=_text(_day()), PrimaryLocation=_place(), secondaryLocations=F.array(F.struct(F.lit("Remote").alias("Name")))), lambda jobs: F.to_json(F.struct(F.array(F.struct(F.size(jobs).alias("TotalJobsCount"), jobs.alias("requisitionList"))).alias("items")))),
        "icims": (boards.icims, _fields(data=F.struct(_key().alias("req_id"), _title().alias("title"), _html().alias("description"), _place().alias("full_location"), _text(_day()).alias("posted_date"))), _under("jobs")),
        "remotive": (boards.remotive, _fields(id=_id(), title=_title(), company_name=F.col("company"), candidate_required_location=_place(), description=_html(), publication_date=_text(_day())), _under("jobs")),
        "arbeitnow": (boards.arbeitnow, _fields(slug=_key(), title=_title(), company_name=F.col("company"), location=_place(), description=_html(), created_at=F.unix_timestamp(_day().cast("timestamp"))), _under("data")),
        "remoteok": (boards.remoteok, _fields(id=_key(), position=_title(), company=F.col("company"), location=_place(), description=_html()), lambda jobs: F.concat(F.lit('[{"legal":"terms"},'), F.substring(F.to_json(jobs), 2, 2**30))),
    }


def _sql(tells: str) -> str:
    place = "CASE WHEN trim(location) IN ('', 'Remote') THEN 'Remote' ELSE location || ' / Remote' END" if "m" in tells else "nullif(trim(location), '')"
    body = "trim(regexp_replace(body, '\\n+', chr(10), 'g'), chr(10))" if "b" in tells else "NULL::VARCHAR"
    day = "strftime(DATE '2024-01-01' + (posting_id % 400)::INT, '%Y-%m-%d')" if "d" in tells else "NULL::VARCHAR"
    return f"WITH {POSTINGS} SELECT company, posting_id::VARCHAR AS external_id, trim(title) AS title, {place} AS location, {body} AS body, {day} AS published FROM p"


def _board(name: str) -> None:
    @query(f"board_{name}", _sql(TELLS[name]))
    def run(spark: SparkSession, d: str) -> DataFrame:
        reader, job, wrap = _shapes()[name]
        got = reader(_pages(spark, d, job, wrap))
        return got.select("company", "external_id", "title", "location", "body", _text(F.col("published_at")).alias("published"))


for _name in TELLS:
    _board(_name)


# ------------------------------------------------- paged boards

def _posted() -> Column:
    return F.when(_id() % 3 == 0, "Posted Today").when(_id() % 3 == 1, F.concat(F.lit("Posted "), (_id() % 30).cast("string"), F.lit(" Days Ago"))).otherwise("Posted 30+ Days Ago")



def _workday_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that repeat their first job on a page of its own; every page says how many jobs the company has."""
    p = postings(spark, d)
    total = p.groupBy("company").agg(F.count("*").alias("total"))
    job = _fields(externalPath=F.concat(F.lit("/job/"), _key()), title=_title(), locationsText=_place(), postedOn=_posted())
    g = p.withColumn("page", F.floor(_id() / PAGE)).groupBy("company", "page").agg(F.sort_array(F.collect_list(job)).alias("jobs")).join(total, "company")
    one = F.array(F.col("jobs"), F.slice("jobs", 1, 1))
    return g.select("company", "page", "total", F.explode(one).alias("jobPostings")).select("company", "page", F.to_json(F.struct("total", "jobPostings")).alias("body"))


@query("board_workday", f"WITH {POSTINGS} SELECT company, '/job/' || posting_id AS external_id, trim(title) AS title, nullif(trim(location), '') AS location, CASE posting_id % 3 WHEN 1 THEN (posting_id % 30)::INT WHEN 2 THEN 30 END AS minimum_age_days FROM p")
def board_workday(spark: SparkSession, d: str) -> DataFrame:
    return boards.workday(_workday_pages(spark, d)).select("company", "external_id", "title", "location", "minimum_age_days")


@query(
    "incomplete_boards",
    f"WITH {POSTINGS}, g AS (SELECT company, count(*) AS announced, count(*) FILTER (floor(posting_id / {PAGE}) % 7 <> 3) AS read, count(*) FILTER (floor(posting_id / {PAGE}) % 7 <> 3) > 0 AS seen FROM p GROUP BY 1) SELECT company, announced, read FROM g WHERE seen AND announced <> read",
)
def incomplete_boards(spark: SparkSession, d: str) -> DataFrame:
    """Boards some of whose pages were not read, told by their own totals: nothing of theirs may be closed."""
    pages = _workday_pages(spark, d).where(F.col("page") % 7 != 3)
    return boards.incomplete(pages, boards.workday(pages), F.from_json("body", boards.WORKDAY)["total"], boards.WORKDAY).select("company", "announced", "read")


@query(
    "paged_boards",
    f"""WITH {POSTINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY posting_id) - 1 AS spot, count(*) OVER (PARTITION BY company) AS announced FROM p),
g AS (SELECT company, spot // {PAGE} AS page, max(announced) AS announced, count(*) AS jobs, max(posting_id) AS last FROM n GROUP BY 1, 2),
b AS (SELECT company, announced, ceil(announced / {PAGE}.0::DOUBLE)::INT AS pages, count(*) FILTER (NOT (company LIKE '%3' AND page % 4 = 1)) AS have FROM g GROUP BY 1, 2)
SELECT company, announced::BIGINT AS announced, (pages - have)::INT AS missing, CASE WHEN pages = have THEN announced ELSE 0 END::BIGINT AS jobs FROM b WHERE have > 0""",
)
def paged_boards(spark: SparkSession, d: str) -> DataFrame:
    """Boards written a file a page, of which some lack pages, and read through the data source: whole boards with their postings, others refused."""
    p = postings(spark, d).withColumn("at", F.row_number().over(Window.partitionBy("company").orderBy("posting_id")) - 1)
    job = F.struct(_title().alias("title"), F.concat(F.lit("/job/"), _key()).alias("externalPath"), _place().alias("locationsText"), F.lit("Posted Today").alias("postedOn"))
    total = p.groupBy("company").agg(F.count("*").alias("total"))
    pages = p.withColumn("page", F.floor(F.col("at") / PAGE).cast("int")).groupBy("company", "page").agg(F.sort_array(F.collect_list(job)).alias("jobPostings")).join(total, "company")
    pages = pages.where(~(F.col("company").endswith("3") & (F.col("page") % 4 == 1))).select("company", "page", F.to_json(F.struct("total", "jobPostings")).alias("body"))
    read = paged.read_pages(spark, paged.pages_written(pages, "pages"), PAGE)
    jobs = F.size(F.from_json("body", boards.WORKDAY)["jobPostings"])
    return read.groupBy("company").agg(F.max("announced").alias("announced"), F.max("missing").alias("missing"), F.sum(F.coalesce(jobs, F.lit(0))).cast("long").alias("jobs"))


def _rippling_pages(spark: SparkSession, d: str) -> DataFrame:
    """A job stands in a page once for each place of two."""
    kind = F.when(_id() % 2 == 0, "REMOTE").otherwise("ON_SITE")
    rows = F.explode(F.array(F.struct(_place().alias("name"), kind.alias("workplaceType")), F.struct(F.lit("Lyon").alias("name"), F.lit("ON_SITE").alias("workplaceType"))))
    p = postings(spark, d).withColumn("page", F.floor(_id() / PAGE)).select("company", "page", _id(), _title(), rows.alias("l"))
    item = F.struct(_key().alias("id"), _title().alias("name"), F.array("l").alias("locations"))
    g = p.groupBy("company", "page").agg(F.sort_array(F.collect_list(item)).alias("items"))
    data = F.struct(F.struct(F.size("items").alias("totalItems"), F.col("items")).alias("data"))
    asked = F.struct(F.array(F.lit("board"), F.lit("x"), F.lit("job-posts")).alias("queryKey"), data.alias("state"))
    page = F.struct(F.struct(F.struct(F.struct(F.array(asked).alias("queries")).alias("dehydratedState")).alias("pageProps")).alias("props"))
    return g.select("company", F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), F.to_json(page), F.lit("</script></html>")).alias("body"))


@query(
    "board_rippling",
    f"""WITH {POSTINGS}, q AS (SELECT *, CASE WHEN posting_id % 2 = 0 AND trim(location) <> '' AND NOT contains(lower(location), 'remote') THEN 'Remote (' || location || ')' ELSE trim(location) END AS place FROM p)
SELECT company, posting_id::VARCHAR AS external_id, trim(title) AS title, array_to_string(list_sort(list_filter([place, 'Lyon'], lambda x: x <> '')), ' / ') AS location FROM q""",
)
def board_rippling(spark: SparkSession, d: str) -> DataFrame:
    return boards.rippling(_rippling_pages(spark, d)).select("company", "external_id", "title", "location")


@query("json_ld_jobs", f"WITH {POSTINGS} SELECT posting_id, title, nullif(trim(location), '') AS location FROM p WHERE posting_id % 5 <> 4")
def json_ld_jobs(spark: SparkSession, d: str) -> DataFrame:
    """schema.org postings at several depths; every fifth page's block is broken."""
    job = F.struct(F.lit("JobPosting").alias("@type"), _title().alias("title"), F.struct(_place().alias("name")).alias("jobLocation"))
    plain, graph, item = F.to_json(job), F.to_json(F.struct(F.array(job).alias("@graph"))), F.to_json(F.struct(F.array(F.struct(job.alias("item"))).alias("itemListElement")))
    k = _id() % 5
    text = F.when(k == 0, plain).when(k == 1, graph).when(k == 2, item).when(k == 3, F.concat(F.lit("["), plain, F.lit("]"))).otherwise(F.lit('{"@type": '))
    pages = postings(spark, d).select("posting_id", F.concat(F.lit("<p><script type='application/ld+json'>"), text, F.lit("</script>")).alias("html"))
    got = boards.json_ld_postings(pages)
    return got.select("posting_id", F.try_variant_get("posting", "$.title", "string").alias("title"), F.nullif(F.trim(F.try_variant_get("posting", "$.jobLocation.name", "string")), F.lit("")).alias("location"))


@query("breezy_details", f"WITH {POSTINGS} SELECT posting_id::VARCHAR AS external_id, CASE WHEN posting_id % 3 <> 0 THEN trim(regexp_replace(body, '\\n+', chr(10), 'g'), chr(10)) END AS body FROM p")
def breezy_details(spark: SparkSession, d: str) -> DataFrame:
    """A listed posting takes its text from its own page; two of three pages are there."""
    _, job, wrap = _shapes()["breezy"]
    block = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.replace(_html(), F.lit("<!-- end -->"), F.lit("")).alias("description")))
    own = postings(spark, d).where(_id() % 3 != 0).select("company", _key().alias("external_id"), F.concat(F.lit('<script type="application/ld+json">'), block, F.lit("</script>")).alias("html"))
    return boards.breezy(_pages(spark, d, job, wrap), details=own).select("external_id", "body")


# ------------------------------------------------- files


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/brindle/{label}-{uuid.uuid4().hex}"


_SITE_SQL = "CASE s_suppkey % 4 WHEN 0 THEN 'https://co' || s_suppkey || '.example/jobs' WHEN 1 THEN '' WHEN 2 THEN 'not a url' ELSE 'https://other.example/a,\"b\"' END"


@query(
    "company_sheet",
    f"SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'no_name' WHEN {_SITE_SQL} = '' THEN 'no_url' WHEN {_SITE_SQL} = 'not a url' THEN 'bad_url' ELSE 'ready' END AS bucket FROM supplier) GROUP BY 1",
)
def company_sheet(spark: SparkSession, d: str) -> DataFrame:
    """A sheet under foreign headers, written and read back; rows fall into buckets."""
    k = F.col("s_suppkey")
    site = F.when(k % 4 == 0, F.concat(F.lit("https://co"), k.cast("string"), F.lit(".example/jobs"))).when(k % 4 == 1, "").when(k % 4 == 2, "not a url").otherwise('https://other.example/a,"b"')
    sheet = table(spark, d, "supplier").select(F.when(k % 9 == 0, "").otherwise(F.col("s_name")).alias("Company Name"), site.alias("Jobs/Careers URL"))
    path = written_files(_folder(spark, "sheet"), lambda p: files.write_csv(sheet, p))
    return files.company_sheet(spark, path).groupBy("bucket").agg(F.count("*").alias("n"))


@query(
    "posting_export",
    f"WITH {POSTINGS} SELECT posting_id, title, body, '[' || posting_id || ',' || size || ']' AS vector, CASE WHEN location = '' THEN 'unknown' WHEN regexp_matches(lower(location), 'remote') THEN 'remote' ELSE 'placed' END AS kind, strftime(DATE '2024-01-01' + (posting_id % 400)::INT + INTERVAL 60 DAY, '%Y-%m-%d') AS expires, (posting_id % 400) + 60 < 200 AS expired FROM p",
)
def posting_export(spark: SparkSession, d: str) -> DataFrame:
    """Every posting with its derived columns as CSV, several lines in a field, read back."""
    kind = F.when(_place() == "", "unknown").when(F.lower(_place()).contains("remote"), "remote").otherwise("placed")
    out = postings(spark, d).select("posting_id", "title", "body", F.array(_id(), F.col("size").cast("long")).alias("vector"), kind.alias("kind"), _text(F.date_add(_day(), 60)).alias("expires"), (_id() % 400 + 60 < 200).alias("expired"))
    path = written_files(_folder(spark, "export"), lambda p: files.write_csv(out, p))
    return spark.read.csv(path, header=True, multiLine=True, escape='"', schema="posting_id long, title string, body string, vector string, kind string, expires string, expired boolean")


@query("journal_rollup", "SELECT event_type AS task, count(*) FILTER (event_id % 10 <> 0) AS calls, count(*) FILTER (event_id % 10 = 0) AS broken FROM events GROUP BY 1")
def journal_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A JSON-lines journal in which every tenth line is cut off: broken lines are counted, not lost."""
    e = table(spark, d, "events")
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.lit("p").alias("provider"), F.col("event_type").alias("task"), F.col("value").alias("ms"), F.lit(True).alias("ok")))
    cut = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit('{"task":"'), "event_type", F.lit('","ms'))).otherwise(line)
    path = written_files(_folder(spark, "journal"), lambda p: e.select(cut.alias("value")).write.text(p))
    j = files.journal(spark, path)
    bad = F.col("_corrupt_record").isNotNull()
    task = F.when(bad, F.regexp_extract("_corrupt_record", '"task":"([a-z]+)', 1)).otherwise(F.col("task"))
    return j.groupBy(task.alias("task")).agg(F.count_if(~bad & F.col("at").isNotNull()).alias("calls"), F.count_if(bad).alias("broken"))


@query("mail_export", "SELECT '<' || p_partkey || '@m>' AS message_id, 'Zoë ' || p_partkey || ' <a@b.example>' AS sender, 'Größe ' || p_type AS subject, 'From here, ' || p_name || ' — ' || p_brand AS body, strftime(TIMESTAMP '2024-01-01 12:00:00' + to_days((p_partkey % 28)::INT), '%Y-%m-%d %H:%M:%S') AS sent FROM part")
def mail_export(spark: SparkSession, d: str) -> DataFrame:
    """Several messages a file, with encoded headers, base64 and multipart bodies and escaped From lines, read back."""
    k = F.col("p_partkey")
    key, word = k.cast("string"), lambda c: F.concat(F.lit("=?utf-8?B?"), F.replace(F.base64(F.encode(c, "UTF-8")), F.lit("\r\n"), F.lit("")), F.lit("?="))
    text = F.concat(F.lit("From here, "), "p_name", F.lit(" — "), "p_brand")
    head = F.concat(F.lit("From a@b.example Mon Jan 01 00:00:00 2024\nMessage-ID: <"), key, F.lit("@m>\nFrom: "), word(F.concat(F.lit("Zoë "), key)), F.lit(" <a@b.example>\nSubject: "), word(F.concat(F.lit("Größe "), "p_type")), F.lit("\nDate: "), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit(" Jan 2024 14:00:00 +0200\nMIME-Version: 1.0\n"))
    coded = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.encode(text, "UTF-8")), F.lit("\n"))
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n>"), text, F.lit("\n"))
    parts = F.concat(F.lit('Content-Type: multipart/alternative; boundary="cut"\n\n--cut\nContent-Type: text/html\n\n<p>other</p>\n--cut\n'), coded, F.lit("--cut--\n"))
    value = F.concat(head, F.when(k % 3 == 0, coded).when(k % 3 == 1, plain).otherwise(parts))
    sent = table(spark, d, "part").select(value.alias("value"))
    path = written_files(_folder(spark, "mail"), lambda p: sent.write.text(p))
    return mail.messages(spark, path).select("message_id", "sender", "subject", "body", F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss").alias("sent"))


@query("vector_import", "SELECT doc_id % 7 <> 0 AS taken, count(*) AS n FROM documents GROUP BY 1")
def vector_import(spark: SparkSession, d: str) -> DataFrame:
    """Exported vectors whose text has changed since are refused."""
    t = table(spark, d, "documents").select("doc_id", "text")
    old = t.select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("digest"))
    yes, no = files.import_vectors(t, old, ["doc_id"])
    return yes.select(F.lit(True).alias("taken")).unionByName(no.select(F.lit(False).alias("taken"))).groupBy("taken").agg(F.count("*").alias("n"))


@query("vector_sync", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'insert' WHEN vec_id % 5 = 1 THEN 'delete' ELSE 'update' END AS action FROM embeddings WHERE vec_id % 5 <= 2")
def vector_sync(spark: SparkSession, d: str) -> DataFrame:
    """What a cache must insert, update and delete to hold the table's vectors."""
    k = F.col("vec_id")
    e = table(spark, d, "embeddings").select("vec_id", F.md5(F.array_join(F.col("embedding").cast("array<string>"), ",")).alias("digest"))
    kept = e.where(k % 5 != 0).select("vec_id", F.when(k % 5 == 2, "old").otherwise(F.col("digest")).alias("digest"))
    return files.sync_sets(e.where(k % 5 != 1), kept, "vec_id", "digest")


@query(
    "metrics_text",
    """WITH g AS (SELECT event_type AS t, count(*) FILTER (value <= 10) AS a, count(*) FILTER (value <= 100) AS b, count(value) AS n FROM events GROUP BY 1)
SELECT unnest(['calls_bucket{event_type="' || t || '",le="10"} ' || a, 'calls_bucket{event_type="' || t || '",le="100"} ' || b, 'calls_bucket{event_type="' || t || '",le="+Inf"} ' || n, 'calls_count{event_type="' || t || '"} ' || n]) AS line FROM g""",
)
def metrics_text(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative buckets and counts in the text exposition format; sums are left to the tests, as their digits differ by engine."""
    lines = files.prometheus_lines(table(spark, d, "events"), "calls", ["event_type"], "value", [10, 100])
    return lines.where(~F.col("line").startswith("calls_sum"))


@query(
    "calendar_text",
    "SELECT o_orderkey AS id, md5('BEGIN:VEVENT' || e || 'UID:' || o_orderkey || e || 'DTSTART:' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || e || 'SUMMARY:' || replace(o_orderpriority, '-', '\\,') || '\\; due' || e || 'END:VEVENT') AS digest FROM orders, (SELECT chr(13) || chr(10) AS e)",
)
def calendar_text(spark: SparkSession, d: str) -> DataFrame:
    """Due orders as calendar events; commas and semicolons are escaped."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.replace("o_orderpriority", F.lit("-"), F.lit(",")), F.lit("; due")).alias("title"), F.col("o_orderdate").alias("due_at"))
    return files.calendar_events(o).select("id", F.md5("ics").alias("digest"))
