"""Claims of a text and whether a source bears them out: every figure, name and term of a claim within one sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.dedup import components
from brindle.session import small_enough, written

# Where sentences end, what a word is, and how long a word must be to claim something by itself.
SENTENCE = r"[.!?]+\s+|\n+"
WORD = r"[0-9][0-9.,]*[0-9]%?|[0-9]%?|\p{L}[\p{L}0-9+#-]*"
LONG = 7
MOST_BROADCAST = 200_000


def sentence_words(text: Column) -> Column:
    """Array of sentences, each an array of its words as they are said; null has none."""
    sentences = F.split(F.coalesce(text, F.lit("")), SENTENCE)
    return F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0)))


def kind_of(word: Column, at: Column) -> Column:
    """What a word claims: year, figure, acronym, name (a capital that begins no sentence) or term (a long word); null if nothing."""
    return (
        F.when(word.rlike("^(19|20)[0-9]{2}$"), "year")
        .when(word.rlike("^[0-9]"), "figure")
        .when(word.rlike(r"^\p{Lu}{2,}[0-9]*$"), "acronym")
        .when((at > 0) & word.rlike(r"^\p{Lu}\p{Ll}"), "name")
        .when(F.length(word) >= LONG, "term")
    )


def normal(word: Column) -> Column:
    """A word as it is compared: lower case, no commas in figures, no s behind a word of four letters or more."""
    w = F.lower(word)
    return F.when(w.rlike("^[0-9]"), F.replace(w, F.lit(","), F.lit(""))).when((F.length(w) >= 4) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def closed(aliases: DataFrame) -> DataFrame:
    """aliases(a, b) -> word, same: words that stand for one another over any number of steps, each with the least of them (in normal form)."""
    pairs = aliases.select(normal(F.col("a")).alias("x"), normal(F.col("b")).alias("y")).where("x != y")
    words = pairs.select(F.explode(F.array("x", "y")).alias("word")).distinct().withColumn("node", F.xxhash64("word"))
    links = pairs.select(F.xxhash64("x").alias("a"), F.xxhash64("y").alias("b"))
    groups = words.join(components(links), "node")
    least = groups.groupBy("root").agg(F.min("word").alias("same"))
    return groups.join(least, "root").select("word", "same")


def _same(rows: DataFrame, aliases: DataFrame | None) -> DataFrame:
    if aliases is None:
        return rows
    side = F.broadcast(aliases) if small_enough(aliases, MOST_BROADCAST) else aliases
    return rows.join(side, "word", "left").withColumn("word", F.coalesce("same", "word")).drop("same")


def supported(claims: DataFrame, key: str, sources: DataFrame, doc: str, text: str = "text", aliases: DataFrame | None = None) -> DataFrame:
    """claims(key, text), sources(doc, text), aliases(word, same: see closed) -> claim, n (different things claimed), kinds, support (sources with a sentence that has all of them), first (the least such source).

    The rarest word of a claim leads to the sentences that can bear it out.
    A sentence is one row with all its words, so the claim's other words are
    looked for where it lies, and only what bears a claim out is moved on.
    Claims of the same words are one. Claims are broadcast while there are few,
    else both sides are dealt out by the rarest words. A claim of nothing has
    n = 0 and no support. `doc` is a key of sources.
    """
    said = claims.select(F.col(key).alias("claim"), F.explode(sentence_words(F.col(text))).alias("s")).select("claim", F.posexplode("s").alias("at", "w"))
    said = said.select("claim", kind_of(F.col("w"), F.col("at")).alias("kind"), normal(F.col("w")).alias("word")).where("kind IS NOT NULL")
    need = written(_same(said, aliases).select("claim", "word", "kind").distinct(), "claimed")
    shape = need.groupBy("claim").agg(F.count_distinct("word").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    need = need.select("claim", "word").distinct()
    read = sources.select(F.col(doc).alias("doc"), F.posexplode(sentence_words(F.col(text))).alias("sentence", "s")).select("doc", "sentence", F.array_distinct(F.transform("s", normal)).alias("words"))
    if aliases is not None:
        read = _same(read.select("doc", "sentence", F.explode("words").alias("word")), aliases).groupBy("doc", "sentence").agg(F.collect_set("word").alias("words"))
    read = written(read.select("doc", "words").where(F.size("words") > 0), "read_words")
    wanted = need.select("word").distinct()
    places = read.select(F.explode("words").alias("word")).join(F.broadcast(wanted) if small_enough(wanted, MOST_BROADCAST) else wanted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("places"))
    rated = need.join(places, "word", "left").groupBy("claim").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "word"))).alias("s"))
    rated = written(rated.where(F.col("s")[0]["places"] > 0).select("claim", F.transform("s", lambda x: x["word"]).alias("asked")), "rated_claims")
    sets = rated.groupBy("asked").agg(F.min("claim").alias("set"))
    anchored = sets.select("set", F.col("asked")[0].alias("word"), F.slice("asked", F.lit(2), F.size("asked")).alias("others"))
    near = read.select("doc", "words", F.explode("words").alias("word")).join(F.broadcast(anchored) if small_enough(anchored, MOST_BROADCAST) else anchored, "word")
    full = near.where(F.forall("others", lambda x: F.array_contains("words", x))).select("set", "doc").distinct()
    got = full.groupBy("set").agg(F.count("*").alias("support"), F.min("doc").alias("first"))
    got = rated.join(sets, "asked").select("claim", "set").join(got, "set").drop("set")
    out = claims.select(F.col(key).alias("claim")).distinct().join(shape, "claim", "left").join(got, "claim", "left")
    return out.select("claim", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), F.coalesce("support", F.lit(0)).alias("support"), "first")
