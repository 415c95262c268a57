"""Mail as columns: headers, encoded words, parts and dates of messages, read without leaving the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the mail formats: encoded words, and zones that have a name.
ENCODED = r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?="
ZONES = {"UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
LATIN = ("iso-8859-1", "latin1", "latin-1", "windows-1252", "cp1252")
_PART = "\u0001"


def let(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.transform(F.array(value), use).getItem(0)


def _text_of(raw: Column, charset: Column) -> Column:
    """Bytes as text; what is not of the charset becomes a replacement character."""
    return F.when(charset.isin(*LATIN), F.decode(raw, "ISO-8859-1")).otherwise(F.make_valid_utf8(raw.cast("string")))


def _unquoted(text: Column) -> Column:
    """Bytes of a quoted-printable text: runs of =XX and what stands between them, in hexadecimal."""
    runs = F.regexp_extract_all(F.regexp_replace(text, "=[ \t]*\n", ""), F.lit(r"(?:=[0-9A-Fa-f]{2})+|[^=]+|="), F.lit(0))
    return F.unhex(F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^(=[0-9A-Fa-f]{2})+$"), F.replace(r, F.lit("="), F.lit(""))).otherwise(F.hex(F.encode(r, "UTF-8")))), ""))


def _from_base64(text: Column) -> Column:
    return F.try_to_binary(F.regexp_replace(text, r"[^A-Za-z0-9+/=]", ""), F.lit("base64"))


def decoded_words(value: Column) -> Column:
    """A header with its encoded words decoded; blanks between two of them go."""

    def one(w: Column) -> Column:
        part = lambda k: F.regexp_extract(w, ENCODED, k)
        raw = F.when(F.lower(part(2)) == "b", _from_base64(part(3))).otherwise(_unquoted(F.replace(part(3), F.lit("_"), F.lit(" "))))
        return F.coalesce(_text_of(raw, F.lower(part(1))), w)

    def whole(v: Column) -> Column:
        coded = F.transform(F.regexp_extract_all(v, F.lit(ENCODED), F.lit(0)), one)
        return let(coded, lambda c: F.array_join(F.transform(F.split(v, ENCODED), lambda p, i: F.concat(p, F.coalesce(F.get(c, i), F.lit("")))), ""))

    return F.when(value.contains("=?"), let(F.regexp_replace(value, r"(\?=)\s+(?==\?)", "$1"), whole)).otherwise(value)


def header(head: Column, name: str) -> Column:
    """A header's value as it stands in unfolded headers; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*)$", 1)), F.lit(""))


def unfolded(head: Column) -> Column:
    return F.regexp_replace(head, r"\n[ \t]+", " ")


def _head(text: Column) -> Column:
    return unfolded(F.when(text.startswith("\n"), "").otherwise(F.substring_index(text, "\n\n", 1)))


def _rest(text: Column) -> Column:
    return F.when(text.startswith("\n"), F.substring(text, F.lit(2), F.length(text))).when(F.instr(text, "\n\n") > 0, F.substring(text, F.instr(text, "\n\n") + 2, F.length(text))).otherwise("")


def body_of(text: Column) -> Column:
    """The first plain part of a message that is no attachment, else the first HTML part, decoded; parts inside parts are read too."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)boundary=\"?([^\"\n;]+)\"?"), F.lit(1)))
    longest_first = F.transform(F.array_sort(F.transform(names, lambda b: F.struct((-F.length(b)).alias("n"), b.alias("b")))), lambda x: x["b"])
    marked = F.aggregate(longest_first, F.concat(F.lit("\n"), F.replace(text, F.lit(_PART), F.lit(" "))), lambda acc, b: F.replace(acc, F.concat(F.lit("\n--"), b), F.lit(_PART)))
    pieces = F.split(marked, _PART)
    parts = F.transform(F.filter(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: ~p.startswith("--")), lambda p: F.regexp_replace(p, r"^[ \t]*\n", ""))
    parts = F.when(F.size(names) > 0, parts).otherwise(F.array(text))
    one = lambda p: let(_head(p), lambda h: F.struct(F.lower(F.coalesce(F.nullif(F.regexp_extract(h, r"(?im)^content-type:[ \t]*([^;\s]+)", 1), F.lit("")), F.lit("text/plain"))).alias("type"), h.rlike(r"(?im)^content-disposition:[ \t]*attachment").alias("attached"), F.lower(F.coalesce(header(h, "content-transfer-encoding"), F.lit(""))).alias("coding"), F.lower(F.regexp_extract(h, r"(?i)charset=\"?([^\s\";]+)", 1)).alias("charset"), _rest(p).alias("text")))

    def chosen(read: Column) -> Column:
        of = lambda kind: F.get(F.filter(read, lambda x: (x["type"] == kind) & ~x["attached"]), F.lit(0))
        return let(F.coalesce(of("text/plain"), of("text/html")), opened)

    def opened(p: Column) -> Column:
        raw = F.when(p["coding"] == "base64", _from_base64(p["text"])).when(p["coding"] == "quoted-printable", _unquoted(p["text"]))
        return F.coalesce(F.when(raw.isNotNull(), _text_of(raw, p["charset"])).otherwise(p["text"]), F.lit(""))

    return F.trim(F.regexp_replace(let(F.transform(parts, one), chosen), r"\A\s+|\s+\z", ""))


def sent_at(value: Column) -> Column:
    """A mail date as a timestamp; without a zone it is UTC, and null if it is none."""
    d = F.trim(F.regexp_replace(F.regexp_replace(value, r"\([^)]*\)|^\s*[A-Za-z]{3,9},", " "), r"\s+", " "))
    d = F.regexp_replace(d, r"( [0-9]{1,2}:[0-9]{2})(?!:)", "$1:00")
    zone = F.regexp_extract(d, r" ([A-Za-z]{1,3})$", 1)
    named = F.element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), F.upper(zone))
    d = F.when((zone != "") & named.isNotNull(), F.concat(F.regexp_replace(d, r" [A-Za-z]{1,3}$", " "), named)).when(d.rlike("[0-9]$") & ~d.rlike(r" [+-][0-9]{4}$"), F.concat(d, F.lit(" +0000"))).otherwise(d)
    return F.try_to_timestamp(d, F.lit("d MMM yyyy HH:mm:ss xx"))


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Mail files (eml, or mbox with several messages) -> path, message_id, sender, subject, body, sent_at.

    An mbox is cut at its From lines as it is read, so a large one is never
    held whole. Rows without a message id take the body's digest. Headers and
    bodies are decoded from UTF-8 and Latin-1; other charsets are read as UTF-8.
    """
    raw = spark.read.text(path, lineSep="\nFrom ").select(F.col("_metadata.file_path").alias("path"), "value")
    # the envelope line goes; inside a text it was escaped by one >
    text = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), r"^(From )?\S+@[^\n]*\n", "")
    rows = raw.where(F.trim("value") != "").select("path", F.regexp_replace(text, r"(?m)^>(>*From )", "$1").alias("text"))
    rows = rows.select("path", "text", _head(F.col("text")).alias("head"))
    h = F.col("head")
    m = rows.select("path", header(h, "message-id").alias("message_id"), decoded_words(header(h, "from")).alias("sender"), decoded_words(header(h, "subject")).alias("subject"), body_of(F.col("text")).alias("body"), sent_at(header(h, "date")).alias("sent_at"))
    return m.withColumn("message_id", F.coalesce("message_id", F.sha2("body", 256)))
