"""File sources and sinks: CSV sheets, JSON lines, vectors, calendars and metrics text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Headers that name the same column.
HEADERS = {"name": ("company name", "company", "name"), "website": ("website url", "website", "url", "homepage"), "careers": ("jobs/careers url", "careers url", "jobs url", "careers")}

JOURNAL = T.StructType([T.StructField(n, t) for n, t in (("at", T.StringType()), ("provider", T.StringType()), ("task", T.StringType()), ("model", T.StringType()), ("ms", T.DoubleType()), ("ok", T.BooleanType()))])


def company_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet under any known headers -> name, website, careers, bucket (ready, no_url, bad_url, no_name)."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    by = {c.strip().lower(): c for c in raw.columns}
    cols = [next((F.trim(F.col(f"`{by[h]}`")) for h in hs if h in by), F.lit(None).cast("string")).alias(k) for k, hs in HEADERS.items()]
    s = raw.select(*cols)
    url = F.coalesce("careers", "website")
    bucket = F.when(F.coalesce("name", F.lit("")) == "", "no_name").when(url.isNull() | (url == ""), "no_url").when(~url.rlike(r"(?i)^https?://[^\s/]+\.[^\s/]+"), "bad_url").otherwise("ready")
    return s.withColumn("bucket", bucket)


def write_csv(df: DataFrame, path: str) -> None:
    """df as CSV with a header, white space kept; arrays become [a,b,...] text."""
    flat = [F.concat(F.lit("["), F.array_join(F.transform(F.col(f.name), lambda x: x.cast("string")), ","), F.lit("]")).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def journal(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines journal under a fixed schema, oldest first inside a file; broken lines are kept in _corrupt_record."""
    schema = T.StructType([*JOURNAL.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record").withColumn("at", F.try_to_timestamp("at"))


def import_vectors(chunks: DataFrame, exported: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) exported vectors: only those whose text digest is that of today's chunk are taken."""
    now = chunks.select(*key, F.md5("text").alias("_now"))
    j = exported.join(now, key, "left")
    fine = F.col("digest").eqNullSafe(F.col("_now"))
    return j.where(fine).drop("_now"), j.where(~fine).drop("_now")


def sync_sets(source: DataFrame, target: DataFrame, key: str, digest: str) -> DataFrame:
    """key -> action: insert, update or delete, to make target like source."""
    j = source.select(F.col(key), F.col(digest).alias("s")).join(target.select(F.col(key), F.col(digest).alias("t")), key, "full_outer")
    act = F.when(F.col("t").isNull(), "insert").when(F.col("s").isNull(), "delete").when(F.col("s") != F.col("t"), "update")
    return j.select(key, act.alias("action")).where("action is not null")


def prometheus_lines(df: DataFrame, name: str, labels: list[str], value: str, bounds: list[float]) -> DataFrame:
    """df -> line: cumulative histogram buckets, sum and count of value for each label set, in the text exposition format."""
    g = df.groupBy(*labels).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("n"), F.sum(value).alias("s"))
    esc = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    tag = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), esc(c), F.lit('"')) for c in labels])
    lines = [F.concat(F.lit(f"{name}_bucket{{"), tag, F.lit(f',le="{b:g}"}} '), F.col(f"b{i}").cast("string")) for i, b in enumerate(bounds)]
    lines += [F.concat(F.lit(f"{name}_bucket{{"), tag, F.lit(',le="+Inf"} '), F.col("n").cast("string")), F.concat(F.lit(f"{name}_sum{{"), tag, F.lit("} "), F.col("s").cast("string")), F.concat(F.lit(f"{name}_count{{"), tag, F.lit("} "), F.col("n").cast("string"))]
    return g.select(F.explode(F.array(*lines)).alias("line"))


def calendar_events(tasks: DataFrame) -> DataFrame:
    """tasks(id, title, due_at) -> id, ics: a VEVENT with escaped text."""
    esc: Column = F.regexp_replace(F.regexp_replace(F.col("title"), r"([\;,])", r"\\$1"), "\n", r"\\n")
    at = F.date_format("due_at", "yyyyMMdd'T'HHmmss'Z'")
    return tasks.select("id", F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("id").cast("string")), F.concat(F.lit("DTSTART:"), at), F.concat(F.lit("SUMMARY:"), esc), F.lit("END:VEVENT")).alias("ics"))
