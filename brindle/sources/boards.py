"""Board payloads (JSON or HTML text columns) as one normal form of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import html_text, parsed_time

#: The normal form that every reader gives.
COLUMNS = ("company", "external_id", "url", "title", "location", "locations", "body", "published_at", "minimum_age_days")

# The published payload shapes of public board interfaces, as far as they are read.
GREENHOUSE = "struct<jobs:array<struct<id:bigint,absolute_url:string,title:string,location:struct<name:string>,content:string,updated_at:string,first_published:string>>>"
LEVER = "array<struct<id:string,hostedUrl:string,text:string,categories:struct<location:string,allLocations:array<string>>,descriptionPlain:string,description:string,createdAt:bigint>>"
ASHBY = "struct<jobs:array<struct<id:string,jobUrl:string,title:string,location:string,secondaryLocations:array<struct<location:string>>,descriptionPlain:string,descriptionHtml:string,publishedAt:string>>>"
WORKABLE = "struct<name:string,jobs:array<struct<shortcode:string,url:string,title:string,city:string,state:string,country:string,description:string,published_on:string>>>"
REMOTIVE = "struct<jobs:array<struct<id:bigint,url:string,title:string,company_name:string,candidate_required_location:string,description:string,publication_date:string>>>"
ARBEITNOW = "struct<data:array<struct<slug:string,url:string,title:string,company_name:string,location:string,description:string,created_at:bigint>>>"
BREEZY = "array<struct<id:string,url:string,name:string,location:struct<name:string>,locations:array<struct<name:string>>,published_date:string>>"
WORKDAY = "struct<total:bigint,jobPostings:array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>>>>"
ORACLE = "struct<items:array<struct<TotalJobsCount:bigint,requisitionList:array<struct<Id:string,Title:string,PostedDate:string,PrimaryLocation:string,secondaryLocations:array<struct<Name:string>>>>>>>"
ICIMS = "struct<totalCount:bigint,jobs:array<struct<data:struct<slug:string,req_id:string,title:string,description:string,full_location:string,posted_date:string>>>>"
REMOTEOK = "array<struct<legal:string,id:string,slug:string,url:string,apply_url:string,position:string,title:string,company:string,location:string,description:string>>"
RIPPLING = "struct<props:struct<pageProps:struct<dehydratedState:struct<queries:array<struct<queryKey:array<string>,state:struct<data:struct<totalItems:bigint,items:array<struct<id:string,name:string,locations:array<struct<name:string,workplaceType:string>>>>>>>>>>>>"
EMBEDDED = r"(?is)<script[^>]*id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>"


def _rows(pages: DataFrame, schema: str, jobs, body: str) -> DataFrame:
    """pages(company, body) -> company, job. A payload that does not parse gives no row; unreadable() finds it."""
    return pages.select("company", F.from_json(F.col(body), schema).alias("p")).select("company", "p", F.explode(jobs(F.col("p"))).alias("j"))


def _form(df: DataFrame, ident: Column, url: Column, title: Column, location: Column, more: Column, text: Column, at: Column, company: Column | None = None, age: Column | None = None) -> DataFrame:
    every = F.array_distinct(F.filter(F.concat(F.array(location), F.coalesce(more, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (F.trim(x) != "")))
    return df.select(
        (company if company is not None else F.col("company")).alias("company"),
        ident.cast("string").alias("external_id"),
        url.alias("url"),
        F.trim(title).alias("title"),
        F.nullif(F.array_join(every, " / "), F.lit("")).alias("location"),
        every.alias("locations"),
        F.nullif(html_text(text), F.lit("")).alias("body"),
        at.alias("published_at"),
        (age if age is not None else F.lit(None)).cast("int").alias("minimum_age_days"),
    ).where(F.col("external_id").isNotNull())


def unreadable(pages: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """Pages whose payload does not parse."""
    return pages.where(F.col(body).isNull() | F.from_json(F.col(body), schema).isNull())


def greenhouse(pages: DataFrame, body: str = "body") -> DataFrame:
    d = _rows(pages, GREENHOUSE, lambda p: p["jobs"], body)
    j = F.col("j")
    return _form(d, j["id"], j["absolute_url"], j["title"], j["location"]["name"], F.lit(None).cast("array<string>"), j["content"], parsed_time(F.coalesce(j["first_published"], j["updated_at"])))


def lever(pages: DataFrame, body: str = "body") -> DataFrame:
    d = _rows(pages, LEVER, lambda p: p, body)
    j = F.col("j")
    return _form(d, j["id"], j["hostedUrl"], j["text"], j["categories"]["location"], j["categories"]["allLocations"], F.coalesce(j["descriptionPlain"], j["description"]), F.timestamp_millis(j["createdAt"]))


def ashby(pages: DataFrame, body: str = "body") -> DataFrame:
    d = _rows(pages, ASHBY, lambda p: p["jobs"], body)
    j = F.col("j")
    return _form(d, j["id"], j["jobUrl"], j["title"], j["location"], F.transform(j["secondaryLocations"], lambda s: s["location"]), F.coalesce(j["descriptionHtml"], j["descriptionPlain"]), parsed_time(j["publishedAt"]))


def workable(pages: DataFrame, body: str = "body") -> DataFrame:
    d = _rows(pages, WORKABLE, lambda p: p["jobs"], body)
    j = F.col("j")
    return _form(d, j["shortcode"], j["url"], j["title"], F.nullif(F.concat_ws(", ", j["city"], j["state"], j["country"]), F.lit("")), F.lit(None).cast("array<string>"), j["description"], parsed_time(j["published_on"]))


def breezy(pages: DataFrame, body: str = "body", details: DataFrame | None = None) -> DataFrame:
    """Postings of the list. With details(company, external_id, html), bodies come from the schema.org block of their own pages."""
    d = _rows(pages, BREEZY, lambda p: p, body)
    j = F.col("j")
    listed = _form(d, j["id"], j["url"], j["name"], j["location"]["name"], F.transform(j["locations"], lambda s: s["name"]), F.lit(None).cast("string"), parsed_time(j["published_date"]))
    if details is None:
        return listed
    text = F.nullif(html_text(F.try_variant_get("posting", "$.description", "string")), F.lit(""))
    own = json_ld_postings(details).groupBy("company", "external_id").agg(F.max(text).alias("body"))
    return listed.drop("body").join(own, ["company", "external_id"], "left").select(*COLUMNS)


def workday(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row a posting of any page; repeated paths of overlapping pages count once. `Posted 30+ Days Ago` gives no date but a least age."""
    d = _rows(pages, WORKDAY, lambda p: p["jobPostings"], body)
    j = F.col("j")
    age = F.regexp_extract(j["postedOn"], r"^Posted ([0-9]+)\+? Days? Ago$", 1).try_cast("int")
    none = F.lit(None)
    return _form(d, j["externalPath"], j["externalPath"], j["title"], j["locationsText"], none.cast("array<string>"), none.cast("string"), none.cast("timestamp"), age=age).dropDuplicates(["company", "external_id"])


def _embedded(pages: DataFrame, body: str) -> DataFrame:
    """company, found (array): the job-posts results inside a page's embedded JSON."""
    p = F.from_json(F.regexp_extract(F.col(body), EMBEDDED, 1), RIPPLING)
    mine = F.filter(p["props"]["pageProps"]["dehydratedState"]["queries"], lambda q: (F.get(q["queryKey"], 0) == "board") & (F.get(q["queryKey"], 2) == "job-posts"))
    return pages.select("company", F.transform(mine, lambda q: q["state"]["data"]).alias("found"))


def rippling_announced(pages: DataFrame, body: str = "body") -> DataFrame:
    """company, announced, read: rows the board says it has (a job once a place), and rows its pages hold."""
    got = _embedded(pages, body).select("company", F.explode("found").alias("p"))
    return got.groupBy("company").agg(F.max("p.totalItems").alias("announced"), F.sum(F.size("p.items")).alias("read"))


def rippling(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row a job, with every place its rows name; a remote place that does not say so is marked."""
    rows = _embedded(pages, body).select("company", F.explode(F.flatten(F.transform("found", lambda p: p["items"]))).alias("j")).where(F.col("j.id").isNotNull())
    name = F.nullif(F.trim(F.col("l.name")), F.lit(""))
    place = F.when((F.col("l.workplaceType") == "REMOTE") & ~F.lower(name).contains("remote"), F.concat(F.lit("Remote ("), name, F.lit(")"))).otherwise(name)
    each = rows.select("company", "j.id", "j.name", F.explode_outer("j.locations").alias("l")).select("company", "id", "name", place.alias("place"))
    jobs = each.groupBy("company", "id").agg(F.max("name").alias("name"), F.array_sort(F.collect_set("place")).alias("places"))
    none = F.lit(None)
    url = F.concat(F.lit("https://ats.rippling.com/"), F.col("company"), F.lit("/jobs/"), F.col("id"))
    return _form(jobs, F.col("id"), url, F.col("name"), none.cast("string"), F.col("places"), none.cast("string"), none.cast("timestamp"))


def oracle(pages: DataFrame, body: str = "body") -> DataFrame:
    d = _rows(pages, ORACLE, lambda p: F.flatten(F.transform(p["items"], lambda i: i["requisitionList"])), body)
    j = F.col("j")
    return _form(d, j["Id"], F.lit(None).cast("string"), j["Title"], j["PrimaryLocation"], F.transform(j["secondaryLocations"], lambda s: s["Name"]), F.lit(None).cast("string"), parsed_time(j["PostedDate"])).dropDuplicates(["company", "external_id"])


def icims(pages: DataFrame, body: str = "body") -> DataFrame:
    d = _rows(pages, ICIMS, lambda p: F.transform(p["jobs"], lambda x: x["data"]), body)
    j = F.col("j")
    return _form(d, F.coalesce(j["req_id"], j["slug"]), F.lit(None).cast("string"), j["title"], j["full_location"], F.lit(None).cast("array<string>"), j["description"], parsed_time(j["posted_date"])).dropDuplicates(["company", "external_id"])


def remotive(pages: DataFrame, body: str = "body") -> DataFrame:
    d = _rows(pages, REMOTIVE, lambda p: p["jobs"], body)
    j = F.col("j")
    return _form(d, j["id"], j["url"], j["title"], j["candidate_required_location"], F.lit(None).cast("array<string>"), j["description"], parsed_time(j["publication_date"]), j["company_name"])


def arbeitnow(pages: DataFrame, body: str = "body") -> DataFrame:
    d = _rows(pages, ARBEITNOW, lambda p: p["data"], body)
    j = F.col("j")
    return _form(d, j["slug"], j["url"], j["title"], j["location"], F.lit(None).cast("array<string>"), j["description"], F.timestamp_seconds(j["created_at"]), j["company_name"])


def remoteok(pages: DataFrame, body: str = "body") -> DataFrame:
    """The feed's jobs; its first entry is a legal notice and no job."""
    d = _rows(pages, REMOTEOK, lambda p: F.filter(p, lambda x: x["legal"].isNull()), body)
    j = F.col("j")
    none = F.lit(None)
    return _form(d, F.coalesce(j["id"], j["slug"]), F.coalesce(j["url"], j["apply_url"]), F.coalesce(j["position"], j["title"]), j["location"], none.cast("array<string>"), j["description"], none.cast("timestamp"), F.coalesce(j["company"], F.lit("unknown")))


def incomplete(pages: DataFrame, read: DataFrame, total: Column, schema: str, body: str = "body") -> DataFrame:
    """Companies whose boards announce another number of postings than was read: they must not close anything."""
    said = pages.select("company", total.alias("total") if total is not None else F.lit(None)).groupBy("company").agg(F.max("total").alias("announced"))
    got = read.groupBy("company").agg(F.count("*").alias("read"))
    return said.join(got, "company", "left").withColumn("read", F.coalesce("read", F.lit(0))).where(~F.col("announced").eqNullSafe(F.col("read")))


def json_ld_postings(pages: DataFrame, html: str = "html", levels: int = 3) -> DataFrame:
    """pages -> its columns and posting (variant): every schema.org JobPosting in ld+json scripts.

    Lists and the wrapper keys @graph, itemListElement, item and mainEntity are
    opened down to `levels`; a block that does not parse loses only itself.
    """
    block = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    others = [c for c in pages.columns if c != html]
    cur = pages.select(*others, F.explode(block).alias("_b")).select(*others, F.try_parse_json("_b").alias("_v")).where(F.col("_v").isNotNull())
    found = None
    for _ in range(levels + 1):
        kind = F.try_variant_get("_v", "$['@type']", "string")
        hit = cur.where((kind == "JobPosting") | F.coalesce(F.array_contains(F.try_variant_get("_v", "$['@type']", "array<string>"), "JobPosting"), F.lit(False)))
        part = hit.select(*others, F.col("_v").alias("posting"))
        found = part if found is None else found.unionByName(part)
        nested = [F.try_variant_get("_v", p, "array<variant>") for p in ("$", "$['@graph']", "$.itemListElement")]
        single = [F.transform(F.filter(F.array(F.try_variant_get("_v", p, "variant")), lambda x: x.isNotNull()), lambda x: x) for p in ("$.item", "$.mainEntity")]
        none = F.array().cast("array<variant>")
        every = F.concat(*[F.coalesce(x, none) for x in (*nested, *single)])
        rest = cur.where(~F.coalesce(kind == "JobPosting", F.lit(False)))
        cur = rest.select(*others, F.explode(every).alias("_v"))
    return found
