"""What résumés and dependency files say: sections, dates, defects, packages. Patterns hold in Java and in RE2 alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sections and the headings that open them.
SECTIONS = (
    ("experience", r"^((work|professional) )?experience:?$|^employment( history)?:?$"),
    ("education", r"^education:?$|^academic background:?$"),
    ("skills", r"^((technical|core) )?skills:?$"),
    ("projects", r"^((selected|personal) )?projects:?$"),
    ("summary", r"^(professional )?summary:?$|^profile:?$"),
)
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_YEAR = r"(?:19|20)[0-9]{2}"
_POINT = rf"(?:(?:{_MONTH}|spring|summer|fall|autumn|winter) {_YEAR}|[0-9]{{1,2}}/{_YEAR})"
_START = rf"(?:{_POINT}|{_YEAR})"
_RANGE = rf"{_START} ?(?:-|–|—|to) ?(?:{_POINT}|{_YEAR}|present|current|now|ongoing)"
_OPEN = rf"{_START} ?(?:-|–|—)"
#: A line that is a date and nothing else; a date behind something else, where a bare year is none; a range without its end.
DATE_ONLY = rf"^ *({_RANGE}|{_OPEN}|{_POINT}|{_YEAR}) *$"
TRAILING = rf"[ ,]+({_RANGE}|{_OPEN}|{_POINT}) *$"
OPEN_END = rf"^ *{_OPEN} *$|[ ,]{_OPEN} *$"
ANY_DATE = rf"{_RANGE}|{_OPEN}|{_POINT}"
#: A line that stands as a heading though no section is known by it: capitals only, four words at most.
HEADING = r"^[A-Z][A-Z&/-]*( [A-Z&/-]+){0,3}$"
# What a defect costs.
COSTS = {"no_email": 0.30, "no_phone": 0.08, "no_links": 0.04, "no_experience": 0.25, "no_education": 0.10, "no_skills": 0.10, "no_dates": 0.15, "unrecognized_heading": 0.12, "open_ended_date": 0.05, "overlong_bullet": 0.02}
LONGEST_BULLET = 300
EMAIL, PHONE, LINK = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", r"\+[0-9][0-9 ()-]{7,}[0-9]", r"https?://"


def section_of(line: Column) -> Column:
    """The section a line opens; null if it opens none."""
    low = F.lower(F.trim(line))
    return reduce(lambda out, s: F.when(low.rlike(s[1]), s[0]).otherwise(out), reversed(SECTIONS), F.lit(None).cast("string"))


def sections(papers: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, section, line: every line under the section above it (preamble before the first); headings and empty lines go."""
    l = papers.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("at", "line")).where(F.trim("line") != "")  # noqa: E741
    own = l.withColumn("own", section_of(F.col("line")))
    above = F.last("own", ignorenulls=True).over(Window.partitionBy(key).orderBy("at"))
    return own.withColumn("section", F.coalesce(above, F.lit("preamble"))).where("own IS NULL").select(key, "at", "section", "line")


def date_only(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, f"(?i){DATE_ONLY}", 1), F.lit(""))


def trailing_date(line: Column) -> Column:
    """The date behind what a line names; null if the line has none or is nothing else."""
    found = F.nullif(F.regexp_extract(line, f"(?i){TRAILING}", 1), F.lit(""))
    return F.when(date_only(line).isNull(), found)


def open_ended(line: Column) -> Column:
    return line.rlike(f"(?i){OPEN_END}")


def defects(papers: DataFrame, key: str, text: str) -> DataFrame:
    """One row a paper: how often it has each defect of COSTS, and parse = 1 less their cost, each repeat costing half of the one before."""
    t, line = F.coalesce(F.col(text), F.lit("")), F.col("line")
    whole = papers.select(key, *[(~t.rlike(p)).cast("int").alias(n) for n, p in (("no_email", EMAIL), ("no_phone", PHONE), ("no_links", LINK))])
    here = lambda s: F.coalesce(F.count_if(F.col("section") == s), F.lit(0))
    dated = F.col("section").isin("experience", "education")
    s = sections(papers, key, text).groupBy(key).agg(
        *[(here(x) == 0).cast("int").alias(f"no_{x}") for x in ("experience", "education", "skills")],
        (F.count_if(dated & line.rlike(f"(?i){ANY_DATE}")) == 0).cast("int").alias("no_dates"),
        F.count_if((F.col("section") != "preamble") & line.rlike(HEADING) & ~line.rlike(f"(?i){ANY_DATE}")).alias("unrecognized_heading"),
        F.count_if(dated & open_ended(line)).alias("open_ended_date"),
        F.count_if(F.col("section").isin("experience", "projects") & (F.length("line") > LONGEST_BULLET)).alias("overlong_bullet"),
    )
    # a paper without a line lacks every section
    empty = {n: int(n.startswith("no_")) for n in COSTS}
    j = whole.join(s, key, "left").select(key, *[F.coalesce(F.col(n), F.lit(empty[n])).cast("long").alias(n) for n in COSTS])
    cost = sum((F.when(F.col(n) > 0, F.lit(c) * (2 - F.pow(F.lit(2.0), 1 - F.col(n)))).otherwise(0.0) for n, c in COSTS.items()), F.lit(0.0))
    return j.withColumn("parse", F.round(F.greatest(F.lit(0.0), 1 - cost), 3))


def packages_in(path: Column, text: Column) -> Column:
    """Sorted names of the packages a dependency file declares, by the file's kind; a file that does not parse declares none."""
    name = F.element_at(F.split(path, "/"), -1)
    body = F.coalesce(text, F.lit(""))
    plain = lambda x: F.lower(F.regexp_replace(x, r"[-_.]+", "-"))
    lines = F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]*([A-Za-z0-9][A-Za-z0-9._-]*)[ \t]*(?:\[[^\]\n]*\])?[ \t]*(?:[=<>!~;#@].*)?$"), F.lit(1))
    node = F.from_json(body, "struct<dependencies:map<string,string>,devDependencies:map<string,string>>")
    keys = lambda m: F.transform(F.coalesce(F.map_keys(m), F.array().cast("array<string>")), F.lower)
    table = F.array_join(F.regexp_extract_all(body, F.lit(r"(?m)^\[(?:workspace\.)?(?:dev-)?dependencies\][ \t]*\n((?:[^\[\n].*\n?|\n)*)"), F.lit(1)), "\n")
    crates = F.regexp_extract_all(table, F.lit(r'(?m)^"?([A-Za-z0-9][A-Za-z0-9_-]*)"?[ \t]*='), F.lit(1))
    found = F.when(name == "package.json", F.concat(keys(node["dependencies"]), keys(node["devDependencies"]))).when(name == "Cargo.toml", F.transform(crates, plain)).when(name.rlike(r"^requirements.*\.txt$"), F.transform(lines, plain)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))))
