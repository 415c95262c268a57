"""Text functions as column expressions: tokens, clean-up, identity keys and fact readers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no signal in postings.
STOPWORDS = (
    "a ability an and applicant apply are as at be by candidate candidates company excellent experience for from good great has have help in "
    "including is it its job like new of on opportunity or other our own part please position role strong team that the to using we will with "
    "work working year years you your"
).split()


#: A term of term_text: two characters or more, the last of which is no dot. Stopwords are still among them.
TERM = re.compile(r"[a-z0-9+#.]+[a-z0-9+#]")


def term_text(text: Column) -> Column:
    """Text in lower case with thousands commas joined: what terms are read from."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([0-9]),(?=[0-9]{3}([^0-9]|$))", "$1")


def tokens(text: Column) -> Column:
    """Lower-case terms of letters, digits, + # and inner dots; thousands commas joined; stopwords and single characters out."""
    return F.filter(F.regexp_extract_all(term_text(text), F.lit(TERM.pattern), F.lit(0)), lambda t: ~t.isin(*STOPWORDS))


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+", " "))


def html_text(html: Column) -> Column:
    """Readable text of HTML: scripts, styles and comments out, block ends as line breaks, tags off, entities back, lines trimmed.

    Tags are taken off twice, as escaped HTML shows its tags only after its entities are back.
    """
    t = F.coalesce(html, F.lit(""))
    t = F.regexp_replace(t, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    for _ in range(2):
        t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|ul|ol|h[1-6]|tr|table|section|article)\s*>", "\n")
        t = F.regexp_replace(t, r"<[^<>]*>", "")
        for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            t = F.replace(t, F.lit(name), F.lit(char))
    lines = F.filter(F.transform(F.split(t, "\n"), squeezed), lambda x: x != "")
    return F.array_join(lines, "\n")


def host_key(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and a leading www."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def content_hash(*fields: Column) -> Column:
    """sha256 of the fields joined by a unit separator; null counts as empty, so fields never move up."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


# Abbreviations of title words.
TITLE_WORDS = {"sr": "senior", "jr": "junior", "eng": "engineer", "engr": "engineer", "dev": "developer", "swe": "software engineer", "mgr": "manager", "ii": "2", "iii": "3", "iv": "4"}


def title_key(title: Column) -> Column:
    """Sorted distinct words of a title with abbreviations written out."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for kv in TITLE_WORDS.items() for x in kv])
    full = F.flatten(F.transform(words, lambda w: F.split(F.coalesce(F.element_at(table, w), w), " ")))
    return F.substring(F.array_join(F.array_sort(F.array_distinct(full)), " "), 1, 300)


def pay_range(text: Column) -> Column:
    """First money range as a struct (low, high, currency, period); null where none is plausible.

    Amounts may use commas or end in k; a k on the high end holds for both. A
    range counts as hourly under 500, else yearly; yearly amounts must lie
    between 10,000 and 2,000,000.
    """
    pat = r"(?i)([$€£])\s?([0-9][0-9,.]*)\s?(k?)\s?(?:-|–|to)\s?[$€£]?\s?([0-9][0-9,.]*)\s?(k?)"
    got = lambda g: F.regexp_extract(text, pat, g)

    def amount(g: int) -> Column:
        k = (F.lower(got(g + 1)) == "k") | (F.lower(got(5)) == "k")
        number = F.regexp_replace(F.regexp_replace(got(g), ",", ""), r"\.$", "").try_cast("double")
        return F.when(k & (number < 1000), number * 1000).otherwise(number)

    low, high = amount(2), amount(4)
    hourly = high < 500
    fine = F.when(hourly, low > 0).otherwise((low >= 10_000) & (high <= 2_000_000))
    currency = F.element_at(F.create_map(F.lit("$"), F.lit("USD"), F.lit("€"), F.lit("EUR"), F.lit("£"), F.lit("GBP")), got(1))
    out = F.struct(low.alias("low"), high.alias("high"), currency.alias("currency"), F.when(hourly, "hour").otherwise("year").alias("period"))
    return F.when((low <= high) & fine, out)


def compare_pay(pay: Column, floor: float, ceiling: float) -> Column:
    """BELOW, WITHIN or ABOVE a wanted yearly range; UNKNOWN without a yearly pay."""
    yearly = pay["period"] == "year"
    return F.when(yearly & (pay["high"] < floor), "BELOW").when(yearly & (pay["low"] > ceiling), "ABOVE").when(yearly, "WITHIN").otherwise("UNKNOWN")


def years_demands(text: Column) -> Column:
    """All `N+ years` demands as structs (years, kind): mandatory, preferred or ambiguous by the words of their line."""
    lines = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\n.;]"), lambda x: x.rlike(r"\b[0-9]{1,2}\s*\+?\s*(?:-\s*[0-9]{1,2}\s*)?(?:years?|yrs?)\b"))

    def read(line: Column) -> Column:
        years = F.regexp_extract(line, r"\b([0-9]{1,2})\s*\+?\s*(?:-\s*[0-9]{1,2}\s*)?(?:years?|yrs?)\b", 1).try_cast("int")
        kind = F.when(line.rlike(r"prefer|nice to have|bonus|ideally|a plus"), "preferred").when(line.rlike(r"\b(must|require|minimum|at least)|[0-9]\s*\+"), "mandatory").otherwise("ambiguous")
        return F.struct(years.alias("years"), kind.alias("kind"))

    return F.transform(lines, read)


# Education levels from low to high, each with what names it.
EDUCATION = (("high_school", r"high school|\bged\b"), ("associate", r"\bassociate'?s?\b"), ("bachelor", r"\bbachelor|\bb\.?s\.?c?\b|undergraduate degree"), ("master", r"\bmaster|\bm\.?s\.?c\b|\bmba\b"), ("doctorate", r"\bph\.?d\b|doctora"))


def least_education(text: Column) -> Column:
    """Lowest level that a text names; null if none."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(None).cast("string")
    for level, pattern in reversed(EDUCATION):
        out = F.when(t.rlike(pattern), level).otherwise(out)
    return out


def authorization(text: Column) -> Column:
    """What a text says of sponsorship: AMBIGUOUS over UNAVAILABLE over AVAILABLE; null if nothing."""
    t = F.lower(F.coalesce(text, F.lit("")))
    no = t.rlike(r"(unable to|cannot|can not|will not|do not|does not|not able to|no)\s+(\w+\s+){0,3}sponsor")
    yes = t.rlike(r"(will|can|able to|we)\s+(\w+\s+){0,2}sponsor|sponsorship (is )?available|visa sponsorship (is )?(offered|provided)")
    return F.when(no & yes & t.rlike("case[- ]by[- ]case|may "), "AMBIGUOUS").when(no, "UNAVAILABLE").when(yes, "AVAILABLE")


# Rungs of seniority, low to high; the first pattern that a title matches wins.
RUNGS = (("intern", r"\bintern(ship)?\b"), ("junior", r"\b(junior|jr|entry|graduate)\b"), ("mid", r"\b(mid|intermediate|ii)\b"), ("senior", r"\b(senior|sr|iii)\b"), ("staff", r"\b(staff|lead)\b"), ("principal", r"\b(principal|architect)\b"), ("executive", r"\b(director|vp|chief|head)\b"))


def rung(title: Column) -> Column:
    """Ordinal of a title's seniority, from 0; null if it names none."""
    out = F.lit(None).cast("int")
    for k, (_, pattern) in reversed(list(enumerate(RUNGS))):
        out = F.when(F.lower(title).rlike(pattern), k).otherwise(out)
    return out


def clipped(text: Column, most: int = 240) -> Column:
    """text cut to most characters, the last three of them dots if it was longer."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def one_time_code(text: Column) -> Column:
    """A code of 4 to 8 digits near the word code; null if none."""
    return F.nullif(F.regexp_extract(F.lower(text), r"(?:code|otp|pin)\D{0,20}([0-9]{4,8})(?![0-9])", 1), F.lit(""))


def parsed_time(raw: Column) -> Column:
    """ISO text, epoch seconds or epoch milliseconds as a timestamp; anything else null."""
    digits = raw.rlike(r"^[0-9]{9,14}$")
    number = F.when(digits, raw.try_cast("long"))
    epoch = F.when(number >= 100_000_000_000, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))
    return F.when(digits, epoch).otherwise(F.try_to_timestamp(raw))


def days_between(start: Column, end: Column) -> Column:
    """Whole elapsed days, never below 0."""
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return F.greatest(F.floor(seconds / 86400), F.lit(0)).cast("int")
