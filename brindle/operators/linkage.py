"""Names in free text, and evidence that a board is a company's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Corporate suffixes, and what companies put around their name in a domain.
SUFFIXES = ("inc", "llc", "ltd", "gmbh", "corp", "co", "ag")
BEFORE = ("try", "get", "join", "use", "hello", "with", "meet", "go", "hey")
BEHIND = ("app", "hq", "inc", "labs", "lab", "ai", "io", "tech", "team", "careers", "jobs")


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def aliases(companies: DataFrame, key: str, name: str) -> DataFrame:
    """key, alias: a name without its brackets, what stands in them, and either without a corporate suffix."""
    n = F.coalesce(F.col(name), F.lit(""))
    parts = F.concat(F.array(F.regexp_replace(n, r"\([^)]*\)", " ")), F.regexp_extract_all(n, F.lit(r"\(([^)]*)\)"), F.lit(1)))
    full = companies.select(key, F.explode(F.transform(parts, words)).alias("w"))
    bare = F.filter("w", lambda x: ~x.isin(*SUFFIXES))
    return full.select(key, F.explode(F.array_distinct(F.array(F.array_join("w", " "), F.array_join(bare, " ")))).alias("alias")).where("alias <> ''").distinct()


def named_in(texts: DataFrame, text_key: str, text: str, companies: DataFrame, key: str, name: str, frequent: DataFrame, longest: int = 6) -> DataFrame:
    """text_key, key: companies that a text names.

    Runs of up to `longest` words are joined with the aliases by equality, so
    only runs that are aliases travel on. An alias of one word counts only if
    it is not in frequent(term), the words that common texts hold.
    """
    a = aliases(companies, key, name).where(F.size(F.split("alias", " ")) <= longest)
    a = a.join(frequent.select(F.col("term").alias("alias")).distinct(), "alias", "left_anti")
    w = texts.select(text_key, words(F.col(text)).alias("w")).where(F.size("w") > 0)

    def runs_of(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: i <= F.size("w") - (n - 1))
        return F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))

    runs = [runs_of(n) for n in range(1, longest + 1)]
    said = w.select(text_key, F.explode(F.array_distinct(F.concat(*runs))).alias("alias"))
    return said.join(a, "alias").select(text_key, key).distinct()


def stem_of(domain: Column) -> Column:
    """The label in front of the last dot, letters and digits only."""
    label = F.element_at(F.split(F.coalesce(domain, F.lit("")), r"\."), -2)
    return F.regexp_replace(F.coalesce(label, F.lit("")), "[^a-z0-9]", "")


def _agrees(label: Column, name: Column) -> Column:
    core = F.regexp_replace(label, f"^({'|'.join(BEFORE)})", "")
    tail = f"({'|'.join(BEHIND)})$"
    forms = F.array(label, core, F.regexp_replace(label, tail, ""), F.regexp_replace(core, tail, ""))
    return (name != "") & (label != "") & (((F.length(label) >= 3) & F.startswith(name, label)) | F.array_contains(forms, name))


def confirmed(candidates: DataFrame) -> DataFrame:
    """candidates(..., slug, why, company, domain, text) -> the same and reason: what shows that the board is the company's own; null if nothing does.

    `why` is how it was found (slug or name), `domain` the registrable domain of
    the company's website, `text` what its board's postings say, in lower case.
    """
    domain, name = F.lower(F.coalesce("domain", F.lit(""))), F.array_join(words(F.col("company")), "")
    alone = F.concat(F.lit(r"(?<![a-z0-9-])\Q"), domain, F.lit(r"\E(?![a-z0-9-])"))
    said = F.regexp_like(F.lower(F.coalesce("text", F.lit(""))), alone)
    reason = (
        F.when(domain == "", "no site known")
        .when((F.col("why") == "slug") & (domain == F.concat(F.lower("slug"), F.lit(".com"))), "owns the .com of its slug")
        .when(said, "board points at the site")
        .when((F.col("why") == "name") & _agrees(stem_of(domain), name), "site and name agree")
    )
    return candidates.withColumn("reason", reason)
