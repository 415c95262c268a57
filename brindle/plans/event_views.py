"""Batch twins of the streams, pages, and message classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import host_key, html_text
from brindle.operators import bayes
from brindle.plans.corpus_views import _tokens_sql
from brindle.plans.registry import query
from brindle.session import table
from brindle.streaming import events as streams


def _text_time(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("hourly_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly(spark: SparkSession, d: str) -> DataFrame:
    return streams.windowed_counts(table(spark, d, "events")).select(_text_time("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(table(spark, d, "events"), "6 hours").select("user_id", _text_time("start"), "n")


@query("event_tail_dedup", "SELECT count(*) AS n FROM (SELECT DISTINCT event_id FROM events)")
def tail(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return streams.tail(e.unionByName(e.where("event_id % 3 = 0"))).agg(F.count("*").alias("n"))


@query("trailing_rate", "SELECT event_type, count(*) AS n, round(count(*) / 1440.0::DOUBLE, 6) AS per_minute FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1440 MINUTE GROUP BY 1")
def trailing(spark: SparkSession, d: str) -> DataFrame:
    return streams.trailing_rate(table(spark, d, "events"), 1440)


@query(
    "host_gap_refusals",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, n, sec AS last, true AS ok FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, CASE WHEN e.sec - last >= 3600 THEN e.sec ELSE last END, e.sec - last >= 3600 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, count(*) FILTER (ok) AS allowed, count(*) FILTER (NOT ok) AS refused FROM w GROUP BY 1""",
)
def gaps(spark: SparkSession, d: str) -> DataFrame:
    return streams.spaced(table(spark, d, "events"), 3600.0).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


@query("host_key_counts", r"SELECT regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '') AS host, count(*) AS n FROM pages GROUP BY 1")
def hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(host_key(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def _html_text_sql(t: str) -> str:
    """What html_text does, with the patterns of another engine: no references back, no possessive repeats."""
    t = f"regexp_replace(coalesce({t}, ''), '<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'gis')"
    for _ in range(2):
        t = f"regexp_replace({t}, '<br\\s*/?>|</(p|div|li|ul|ol|h[1-6]|tr|table|section|article)\\s*>', chr(10), 'gi')"
        t = f"regexp_replace({t}, '<[^<>]*>', '', 'g')"
        for name, char in (("nbsp", "' '"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("#39", "chr(39)"), ("amp", "'&'")):
            t = f"replace({t}, '&{name};', {char})"
    return f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))), lambda x: x <> ''), chr(10))"


@query("html_text_stats", f"SELECT page_id, length(t)::INT AS chars, len(string_split(t, chr(10)))::INT AS lines FROM (SELECT page_id, {_html_text_sql('html')} AS t FROM pages)")
def html_stats(spark: SparkSession, d: str) -> DataFrame:
    text = html_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(text).alias("chars"), F.size(F.split(text, "\n")).alias("lines"))


_NB_TOK = _tokens_sql("text")


@query(
    "nb_message_roles",
    f"""WITH t AS (SELECT conv_id, turn, role, {_NB_TOK} AS tok FROM conversations WHERE role IS NOT NULL), c AS (SELECT role, count(*) AS docs, sum(len(tok)) AS words FROM t GROUP BY 1), k AS (SELECT role, term, count(*) AS n FROM (SELECT role, unnest(tok) AS term FROM t) GROUP BY 1, 2),
v AS (SELECT count(DISTINCT term) AS v FROM k), p AS (SELECT role, ln(docs / (SELECT sum(docs) FROM c)::DOUBLE) AS prior, words + v AS den FROM c, v), f AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest(tok) AS term FROM t) GROUP BY 1, 2, 3),
m AS (SELECT f.conv_id, f.turn, p.role, sum(tf * ln((coalesce(n, 0) + 1.0::DOUBLE) / den)) AS ll FROM f CROSS JOIN p LEFT JOIN k ON k.role = p.role AND k.term = f.term GROUP BY 1, 2, 3),
s AS (SELECT x.conv_id, x.turn, p.role AS predicted, round(prior + coalesce(ll, 0), 6) AS score FROM (SELECT DISTINCT conv_id, turn FROM t) x CROSS JOIN p LEFT JOIN m ON m.conv_id = x.conv_id AND m.turn = x.turn AND m.role = p.role)
SELECT conv_id, turn, predicted, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, predicted) AS rn FROM s) WHERE rn = 1""",
)
def message_roles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role is not null")
    classes, ll = bayes.train(rows, "role", "text")
    return bayes.classify(rows, ["conv_id", "turn"], "text", classes, ll)


_RULES = (("thanks", r"\b(thanks|thank you)\b"), ("question", r"[?]"))


@query("tiered_messages", "SELECT role, CASE WHEN regexp_matches(lower(coalesce(text, '')), '\\b(thanks|thank you)\\b') THEN 'thanks' WHEN regexp_matches(lower(coalesce(text, '')), '[?]') THEN 'question' WHEN length(coalesce(text, '')) > 200 THEN 'long' ELSE 'other' END AS class, count(*) AS n FROM conversations GROUP BY 1, 2")
def tiered_messages(spark: SparkSession, d: str) -> DataFrame:
    """Rules first; what they leave open goes to the next tier, and the last always commits."""
    from brindle.functions.readers import first_match

    said = F.lower(F.coalesce("text", F.lit("")))
    tiers = F.coalesce(first_match(said, _RULES), F.when(F.length(F.coalesce("text", F.lit(""))) > 200, "long"), F.lit("other"))
    return table(spark, d, "conversations").groupBy("role", tiers.alias("class")).agg(F.count("*").alias("n"))
