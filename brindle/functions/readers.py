"""What postings, titles and addresses say, as column expressions. Patterns hold in Java and in RE2 alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roles and what names them, longest name first; groups of titles; skills.
ROLES = (
    ("machine learning engineer", "machine_learning"),
    ("site reliability engineer", "reliability"),
    ("software engineer", "software"),
    ("software developer", "software"),
    ("product manager", "product"),
    ("data scientist", "data_science"),
    ("data engineer", "data_engineering"),
    ("ml engineer", "machine_learning"),
    ("sre", "reliability"),
)
GROUPS = (
    ("not_it", r"\b(nurse|driver|chef|teacher|sales)\b"),
    ("product", r"\b(product|program) manager\b"),
    ("data", r"\b(data|machine learning|ml)\b"),
    ("operations", r"\b(reliability|sre|devops|systems)\b"),
    ("software", r"\b(software|developer|frontend|backend)\b"),
)
SKILLS = (("python", r"\bPython\b"), ("go", r"\bGo(lang)?\b"), ("kafka", r"\bKafka\b"), ("sql", r"\bSQL\b"), ("spark", r"\bSpark\b"), ("kubernetes", r"\b(Kubernetes|K8s)\b"))
LEVEL_WORDS = r"\b(senior|sr|junior|jr|staff|principal|lead|intern|mid|ii|iii|iv|remote)\b"
HEADINGS = (("required", r"^(basic |minimum )?(requirements|qualifications|what you need|must have)s?:?$"), ("preferred", r"^(nice to have|preferred( qualifications)?|bonus( points)?):?$"), ("unclassified", r"^(about us|benefits|the role|what we offer):?$"))
LINE_PREFERRED = r"\b(preferred|nice to have|a plus|bonus|ideally)\b"
LINE_REQUIRED = r"\b(required|must|minimum|at least)\b"
BOARDS = (
    ("greenhouse", r"boards\.greenhouse\.io/([a-z0-9_-]+)"),
    ("lever", r"jobs\.lever\.co/([a-z0-9_-]+)"),
    ("ashby", r"jobs\.ashbyhq\.com/([a-z0-9_-]+)"),
    ("workable", r"apply\.workable\.com/([a-z0-9_-]+)"),
    ("workday", r"([a-z0-9]+)\.wd[0-9]+\.myworkdayjobs\.com"),
)
CLOSED = r"(no longer (available|accepting)|position (has been )?(filled|closed)|job (has )?expired)"
FIGURE = r"[$€£]?[0-9]+(?:[.,][0-9]+)*%?"
SUFFIXES = (("ies", "y"), ("sses", "ss"), ("ing", ""), ("ed", ""), ("ers", "er"), ("s", ""))


def first_match(text: Column, rules: tuple) -> Column:
    """The name of the first rule whose pattern the text holds; null if none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def surface(title: Column) -> Column:
    """Lower case without qualifiers in brackets or behind a dash, and without punctuation."""
    t = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\([^)]*\)| - .*$", " ")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def _role(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for alias, role in reversed(ROLES):
        out = F.when(F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {alias} "), role).otherwise(out)
    return out


def role_of(title: Column) -> Column:
    """The role a title names by its longest alias, as it stands or without words of level; null if none."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(surface(title), LEVEL_WORDS, " "), r" +", " "))
    return F.coalesce(_role(surface(title)), _role(plain))


def title_group(title: Column) -> Column:
    """The group of titles it belongs to; null if none or if a word rules it out."""
    return F.nullif(first_match(F.lower(F.coalesce(title, F.lit(""))), GROUPS), F.lit("not_it"))


def skills_in(text: Column) -> Column:
    """Skills named in a text, once each, in the vocabulary's order; case matters."""
    found = F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in SKILLS])
    return F.filter(found, lambda x: x.isNotNull())


def heading_kind(line: Column) -> Column:
    """required, preferred or unclassified if the line is a heading, else null."""
    return first_match(F.lower(F.trim(line)), HEADINGS)


def line_strength(line: Column, heading: Column) -> Column:
    """How a line asks for what it names: by its own words, else by the heading above it."""
    low = F.lower(line)
    return F.when(low.rlike(LINE_PREFERRED), "preferred").when(low.rlike(LINE_REQUIRED), "required").otherwise(F.coalesce(heading, F.lit("unclassified")))


def is_option(line: Column, pattern: str) -> Column:
    """Whether a line offers what the pattern names as a choice or as an example."""
    return line.rlike(rf"({pattern}) ?(or\b|/)|(\bor|/) ?({pattern})|(such as|e\.g\.) [^.;]*({pattern})")


def board_of(url: Column) -> Column:
    """(ats, slug) that the shape of an address tells; null if none."""
    low = F.lower(F.coalesce(url, F.lit("")))
    out = F.lit(None).cast("struct<ats:string,slug:string>")
    for ats, pattern in reversed(BOARDS):
        out = F.when(low.rlike(pattern), F.struct(F.lit(ats).alias("ats"), F.regexp_extract(low, pattern, 1).alias("slug"))).otherwise(out)
    return out


def slug_candidates(name: Column) -> Column:
    """Likely slugs of a company's name, likeliest first: joined, dashed, without legal form, first word."""
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]+", " "))
    bare = F.trim(F.regexp_replace(low, r"\b(inc|llc|ltd|gmbh|corp|co)\b", " "))
    many = F.array(F.replace(bare, F.lit(" "), F.lit("")), F.replace(bare, F.lit(" "), F.lit("-")), F.replace(low, F.lit(" "), F.lit("")), F.element_at(F.split(bare, " "), 1))
    return F.filter(F.array_distinct(many), lambda x: x != "")


def liveness(status: Column, body: Column) -> Column:
    """open, closed or unknown by a page's status and text."""
    gone = F.lower(F.coalesce(body, F.lit(""))).rlike(CLOSED)
    return F.when(status.isin(404, 410) | ((status == 200) & gone), "closed").when(status == 200, "open").otherwise("unknown")


def light_stem(word: Column) -> Column:
    """A word without its commonest ending; what is left has three letters or more."""
    out = word
    for suffix, instead in reversed(SUFFIXES):
        out = F.when(word.rlike(f"^.{{3,}}{suffix}$"), F.regexp_replace(word, f"{suffix}$", instead)).otherwise(out)
    return out


def figures(text: Column) -> Column:
    """Numbers of a text with their sign of currency or share, thousands joined, once each and sorted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FIGURE), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))))


def proper_nouns(text: Column) -> Column:
    """Words that are capitalised wherever they stand, sorted. One set difference, so a long text costs its length."""
    words = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b[A-Za-z][a-z]{2,}\b"), F.lit(0)))
    capital = F.transform(F.filter(words, lambda w: w.rlike("^[A-Z]")), F.lower)
    return F.array_sort(F.transform(F.array_except(capital, words), F.initcap))


#: What is masked before a text leaves, by kind.
MASKED = (("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"), ("PHONE", r"\+[0-9][0-9 ()-]{7,}[0-9]"))


def masked(text: Column) -> tuple[Column, Column]:
    """(text with each different contact as <KIND_n>, the contacts of each kind in order), which unmasked() undoes."""
    out, kept = F.coalesce(text, F.lit("")), []
    for kind, pattern in MASKED:
        found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)))
        kept.append(found)
        # longest first, so that a contact inside a longer one never cuts it
        order = F.array_sort(F.transform(found, lambda x, i: F.struct((-F.length(x)).alias("n"), x.alias("x"), i.alias("i"))))
        out = F.aggregate(order, out, _replace("x", lambda c, kind=kind: F.concat(F.lit(f"<{kind}_"), c["i"].cast("string"), F.lit(">"))))
    return out, F.struct(*[k.alias(kind) for (kind, _), k in zip(MASKED, kept)])


def _replace(what: str, by):
    return lambda t, c: F.replace(t, c[what], by(c))


def _restore(kind: str):
    return lambda t, c: F.replace(t, F.concat(F.lit(f"<{kind}_"), c["i"].cast("string"), F.lit(">")), c["x"])


def unmasked(text: Column, contacts: Column) -> Column:
    out = text
    for kind, _ in MASKED:
        pairs = F.transform(contacts[kind], lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        out = F.aggregate(pairs, out, _restore(kind))
    return out


def changed_fields(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Names of the fields whose values differ; two nulls are alike."""
    return F.filter(F.array(*[F.when(~before[k].eqNullSafe(after[k]), F.lit(k)) for k in before]), lambda x: x.isNotNull())
