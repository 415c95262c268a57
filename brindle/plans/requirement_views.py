"""Requirements, roles and restrictions read from postings whose lines are made of vocabulary names; the SQL knows what was put in, not how it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import vocabularies
from brindle.operators.requirements import requirements, restricted, role_of, vocabulary
from brindle.plans.registry import query
from brindle.session import table

_SKILLS, _ROLES = vocabularies.parsed(vocabularies.SKILLS), vocabularies.parsed(vocabularies.ROLES)
#: Pieces of a posting: text, or a slot (its pace through the spellings, its strength, whether it is a choice).
LAYOUT = (
    "About us\nWe build maps with ", (7, "unclassified", False), ".\nRequirements\n", (11, "required", True), " or ", (13, "required", True), "\n", (17, "preferred", False), " is a plus\n",
    "Nice to have:\n", (19, "preferred", False), ", ", (23, "preferred", False), "; 3 years\nmust know ", (29, "required", False), "\nAbout us\nat least ", (31, "required", False), " and tea",
)
TITLES = ("Senior {} (Remote)", "{}, Maps", "Lead {} - {}", "Nurse")
LIMITS = (
    ("We ship maps.", False, False), ("An active TS/SCI is needed.", True, False), ("No security clearance is needed.", False, False), ("Top Secret clearance preferred", False, False), ("Must be a U.S. citizen.", False, True),
    ("US citizenship and a security clearance", True, True), ("Regardless of US citizenship, apply.", False, False), ("Subject to ITAR.\nNo polygraph, no clearance.", False, True), ("US persons only. Public trust position.", True, True), ("US citizenship not required", False, False),
)


def _spelling(pace: int) -> Column:
    names = F.array(*[F.lit(s) for _, s, _ in _SKILLS])
    return F.element_at(names, ((F.col("p_partkey") * pace + pace) % len(_SKILLS) + 1).cast("int"))


def _values(rows: list[tuple[str, str, bool]]) -> str:
    text = lambda s: s.replace("'", "''")
    return ", ".join(f"({i}, '{text(e)}', '{text(s)}')" for i, (e, s, _) in enumerate(rows))


_SLOTS = [x for x in LAYOUT if isinstance(x, tuple)]
_PUT = " UNION ALL ".join(f"SELECT p_partkey, (p_partkey * {pace} + {pace}) % {len(_SKILLS)} AS i, {('required', 'preferred', 'unclassified').index(strength)} AS rank, {n} AS place, {choice} AS choice FROM part" for n, (pace, strength, choice) in enumerate(_SLOTS))


@query(
    "requirement_reading",
    f"WITH v(i, entry, spelling) AS (VALUES {_values(_SKILLS)}), s AS ({_PUT}) SELECT p_partkey AS posting_id, entry, ['required', 'preferred', 'unclassified'][min(rank) + 1] AS strength, arg_min(choice, rank * 100 + place) AS choice FROM s JOIN v USING (i) GROUP BY 1, 2",
)
def requirement_reading(spark: SparkSession, d: str) -> DataFrame:
    """Skills of a vocabulary in postings: strength by line or heading, and whether they are offered among others."""
    body = F.concat(*[F.lit(x) if isinstance(x, str) else _spelling(x[0]) for x in LAYOUT])
    docs = table(spark, d, "part").select("p_partkey", body.alias("body"))
    got = requirements(docs, "p_partkey", "body", vocabulary(spark, vocabularies.SKILLS))
    return got.select(F.col("doc").alias("posting_id"), "entry", "strength", "choice")


_R = len(_ROLES)


@query(
    "role_reading",
    f"""WITH v(i, entry, spelling) AS (VALUES {_values(_ROLES)}), t AS (SELECT p_partkey, p_partkey % 4 AS k, a.entry AS ea, len(regexp_extract_all(a.spelling, '[A-Za-z0-9]+')) AS na, b.entry AS eb, len(regexp_extract_all(b.spelling, '[A-Za-z0-9]+')) AS nb FROM part JOIN v a ON a.i = p_partkey % {_R} JOIN v b ON b.i = p_partkey * 7 % {_R})
SELECT p_partkey AS posting_id, CASE WHEN k = 2 AND nb > na THEN eb ELSE ea END AS role FROM t WHERE k <> 3""",
)
def role_reading(spark: SparkSession, d: str) -> DataFrame:
    """Roles of titles by any of their spellings, the longest of two."""
    k, names = F.col("p_partkey"), F.array(*[F.lit(s) for _, s, _ in _ROLES])
    one, two = (F.element_at(names, (k * pace % _R + 1).cast("int")) for pace in (1, 7))
    forms = [F.concat(*[y for n, part in enumerate(form.split("{}")) for y in ([F.lit(part)] if n == 0 else [(one, two)[n - 1], F.lit(part)])]) for form in TITLES]
    titles = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*forms), (k % 4 + 1).cast("int")).alias("title"))
    return role_of(titles, "p_partkey", "title", vocabulary(spark, vocabularies.ROLES)).select(F.col("doc").alias("posting_id"), "role")


@query("restricted_postings", "SELECT p_partkey AS posting_id, p_partkey % 10 IN (1, 5, 8) AS clearance, p_partkey % 10 IN (4, 5, 7, 8) AS citizens FROM part")
def restricted_postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings that ask for a clearance or for citizens, and those that say they do not."""
    text = F.element_at(F.array(*[F.lit(t) for t, _, _ in LIMITS]), (F.col("p_partkey") % 10 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("posting_id"), restricted(text, vocabularies.CLEARANCE, vocabularies.NO_CLEARANCE).alias("clearance"), restricted(text, vocabularies.CITIZEN, vocabularies.NO_CITIZEN).alias("citizens"))
