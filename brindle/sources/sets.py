"""Files that people keep by hand: registries and labelled sets in YAML, question sets in JSON, directories of boards in CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a question may expect, the share of questions held out, where a label may come from, and the headers of board directories (vendor, slug, company).
EXPECTS = ("answer", "none", "not_searched")
HELD_OUT_PERCENT = 30
PROVENANCES = ("fixture", "owner", "feedback")
DIRECTORIES = (("ats_vendor", "board_slug", "company_name"), ("platform", "token", "company"))
QUESTIONS = "version string, depth int, modes map<string, map<string, string>>, questions array<struct<key:string, question:string, stratum:string, expect:string>>"


class UnreadableSet(ValueError):
    """A file that is there but is not what it should be."""


def _unquoted(value: Column) -> Column:
    """A scalar without its quotes and comment; ~ and null are null, doubled single quotes are one."""
    single, double = value.rlike("(?s)^'.*'$"), value.rlike('(?s)^".*"$')
    inner = F.substring(value, F.lit(2), F.greatest(F.length(value) - 2, F.lit(0)))
    plain = F.trim(F.regexp_replace(value, r"(^|\s)#.*$", ""))
    mark = F.lit("\u0001")  # a doubled backslash, until all else that a backslash changes is done
    opened = F.replace(F.replace(F.replace(inner, F.lit("\\\\"), mark), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    text = F.when(single, F.replace(inner, F.lit("''"), F.lit("'"))).when(double, F.replace(opened, mark, F.lit("\\"))).otherwise(plain)
    return F.when(~plain.isin("", "~", "null"), text)


def yaml_lists(spark: SparkSession, path: str) -> DataFrame:
    """YAML files of flat mappings in lists -> file, section, item, entry (map of text).

    The form that registries have: top-level keys, under each of them a list of
    flat mappings or one scalar (item 0, key "value"). Scalars may be quoted, go
    on in deeper lines (joined by a blank), or be blocks (| keeps newlines, >
    joins). A section without items gives one row with a null entry, so that
    "empty" and "missing" differ. Lines are read in columns; a file is one row.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    lines = files.where(~F.col("line").rlike(r"^\s*(#.*)?$|^---"))
    in_file = Window.partitionBy("file").orderBy("n")
    top = r"(?s)^([A-Za-z_][\w-]*):\s*(.*)$"
    lines = lines.withColumn("section", F.last(F.nullif(F.regexp_extract("line", top, 1), F.lit("")), ignorenulls=True).over(in_file))
    pair = r"(?s)^(\s*(?:- +)?)([A-Za-z_][\w-]*):(?:\s+(.*))?$"
    # an item begins at a dash as deep as the first one of its section
    of_section = Window.partitionBy("file", "section").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dash = F.when(F.col("line").rlike(r"^\s*- "), F.length(F.regexp_extract("line", r"^(\s*)", 1)))
    lines = lines.withColumn("is_top", F.col("line").rlike(top)).withColumn("starts", F.coalesce(dash == F.first(dash, ignorenulls=True).over(of_section), F.lit(False)))
    item = F.sum(F.col("starts").cast("int")).over(Window.partitionBy("file", "section").orderBy("n"))
    lines = lines.withColumn("item", F.when(F.col("is_top"), 0).otherwise(item))
    depth = F.length(F.regexp_extract("line", pair, 1))
    # a pair lies as deep as the first one of its section's items; what lies deeper goes on the value before
    level = F.first(F.when(F.col("starts"), depth), ignorenulls=True).over(of_section)
    is_pair = F.col("is_top") | (F.col("line").rlike(pair) & (depth == level))
    lines = lines.withColumn("pair", is_pair).withColumn("k", F.sum(is_pair.cast("int")).over(in_file))
    key = F.when(F.col("is_top"), "value").otherwise(F.regexp_extract("line", pair, 2))
    head = F.when(F.col("is_top"), F.regexp_extract("line", top, 2)).otherwise(F.regexp_extract("line", pair, 3))
    said = lines.groupBy("file", "section", "item", "k").agg(
        F.max(F.when(F.col("pair"), key)).alias("key"), F.max(F.when(F.col("pair"), F.trim(head))).alias("head"),
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("pair"), F.struct("n", "line")))), lambda x: F.trim(x["line"])).alias("more"),
    )
    block = F.col("head").rlike(r"^[|>][+-]?$")
    flat = _unquoted(F.trim(F.array_join(F.concat(F.array("head"), F.col("more")), " ")))
    value = F.when(block, F.when(F.col("head").startswith("|"), F.array_join("more", "\n")).otherwise(F.array_join("more", " "))).otherwise(flat)
    said = said.withColumn("text", value)
    entry = F.map_from_entries(F.collect_list(F.when((F.col("key") != "value") | F.col("text").isNotNull(), F.struct("key", "text"))))
    rows = said.where(F.col("key").isNotNull() & ~F.coalesce(F.col("text").isin("[]", "{}") & (F.col("item") == 0), F.lit(False))).groupBy("file", "section", "item").agg(entry.alias("entry")).where((F.size("entry") > 0) | (F.col("item") > 0))
    empty = lines.select("file", "section").distinct().join(rows.select("file", "section").distinct(), ["file", "section"], "left_anti")
    return rows.unionByName(empty.select("file", "section", F.lit(0).alias("item"), F.lit(None).cast("map<string,string>").alias("entry")))


def registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A company registry -> (companies, retired): name, slug, ats, poll_interval_s, checked, state.

    A file without a companies list is refused, as it would read like an empty
    registry; `companies: []` is one.
    """
    rows = yaml_lists(spark, path)
    lacking = rows.groupBy("file").agg(F.max(F.col("section").eqNullSafe("companies")).alias("has")).where("NOT has")
    if rows.isEmpty() or not lacking.isEmpty():
        raise UnreadableSet(f"{path}: a file has no companies: list")
    get = lambda k: F.try_element_at("entry", F.lit(k))
    form = rows.where("item > 0").select("section", get("name").alias("name"), get("slug").alias("slug"), F.coalesce(get("ats"), F.lit("greenhouse")).alias("ats"), get("poll_interval_s").try_cast("long").alias("poll_interval_s"), get("checked").alias("checked"), get("state").alias("state"))
    of = lambda s: form.where(F.col("section") == s).drop("section")
    return of("companies"), of("retired")


def _double_quoted(value: Column) -> Column:
    escaped = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def yaml_text(rows: DataFrame, file: str, section: str, order: str, sections: tuple[str, ...]) -> DataFrame:
    """rows(file, section, order, fields) -> file, value: a YAML file of lists for each file number, all sections in it, which `yaml_lists` reads back; fields that are null are left out."""
    names = [c for c in rows.columns if c not in (file, section, order)]
    lines = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), _double_quoted(F.col(c).cast("string")))) for c in names]))
    one = rows.select(file, section, order, F.concat(F.lit("- "), F.array_join(lines, "\n  ")).alias("text"))
    of = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col(section) == s, F.struct(order, "text")))), lambda x: x["text"])
    part = lambda s: F.when(F.size(of(s)) > 0, F.concat(F.lit(f"{s}:\n"), F.array_join(of(s), "\n"))).otherwise(f"{s}: []")
    return one.groupBy(file).agg(F.concat_ws("\n", *[part(s) for s in sections]).alias("value"))


def labelled_set(spark: SparkSession, path: str) -> DataFrame:
    """Labelled sets -> file, key, title, description, relevance, provenance, company, location; refused if a posting lacks a field, repeats a key or has an unknown provenance."""
    rows = yaml_lists(spark, path).where("section = 'postings' AND item > 0")
    get = lambda k: F.try_element_at("entry", F.lit(k))
    form = rows.select("file", *[get(k).alias(k) for k in ("key", "title", "description")], get("relevance").try_cast("int").alias("relevance"), get("provenance").alias("provenance"), F.coalesce(get("company"), F.lit("")).alias("company"), F.coalesce(get("location"), F.lit("Remote")).alias("location"))
    lacking = F.exists(F.array(*[F.col(c).isNull() for c in ("key", "title", "description", "relevance", "provenance")]), lambda x: x)
    bad = form.select(F.count_if(lacking).alias("lacking"), F.count_if(~F.col("provenance").isin(*PROVENANCES)).alias("unknown"), F.count("*").alias("n")).first()
    again = form.groupBy("file", "key").count().where("count > 1").isEmpty()
    if not bad.n or bad.lacking or bad.unknown or not again:
        raise UnreadableSet(f"{path}: {bad.n} postings, {bad.lacking} lack a field, {bad.unknown} of unknown provenance, keys {'differ' if again else 'repeat'}")
    return form


def held_out(key: Column) -> Column:
    """Whether a key is among the HELD_OUT_PERCENT that tuning must not see: by the first byte of its digest."""
    return F.floor(F.conv(F.substring(F.sha2(key, 256), 1, 2), 16, 10).cast("int") * 100 / 256) < HELD_OUT_PERCENT


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """A JSON question set -> version, depth, key, question, stratum, expect, held_out; refused if a key repeats or is too long, or an expectation is unknown."""
    raw = spark.read.schema(QUESTIONS).json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("file"))
    rows = raw.select("file", "version", "depth", F.explode("questions").alias("q")).select("file", "version", "depth", "q.*")
    wrong = ~F.col("expect").isin(*EXPECTS) | F.col("key").isNull() | ~F.length("key").between(1, 64) | (F.length("stratum") > 32) | (F.col("depth") <= 0) | ~F.length("version").between(1, 32)
    bad = rows.where(F.coalesce(wrong, F.lit(True)))
    if not bad.isEmpty() or not rows.groupBy("file", "key").count().where("count > 1").isEmpty() or rows.isEmpty():
        raise UnreadableSet(f"{path}: keys must differ and have 1 to 64 characters, and a question expects one of {', '.join(EXPECTS)}")
    return rows.withColumn("held_out", held_out(F.col("key"))).drop("file")


def board_directories(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Directory files of either published form -> vendor, slug, company, once each; a file of neither form is refused."""
    out = None
    for path in paths:
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
        names = next((n for n in DIRECTORIES if set(n) <= set(raw.columns)), None)
        if names is None:
            raise UnreadableSet(f"{path}: not a known board directory ({', '.join(raw.columns)})")
        vendor, slug, company = (F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in names)
        rows = raw.select(F.lower(vendor).alias("vendor"), slug.alias("slug"), company.alias("company")).where("slug != ''")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()
