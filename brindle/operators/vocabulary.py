"""A vocabulary of any size found in texts: hashed word sequences joined with it, leftmost and longest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.keywords import said_words
from brindle.session import small_enough, written

MOST_BROADCAST = 200_000


def entries(vocabulary: DataFrame) -> DataFrame:
    """vocabulary(entry, spelling, cased) -> entry, spelling (words joined by a blank, lower case unless cased), cased, n, h: one row a spelling, its least entry; spellings without a word are left out."""
    words = said_words(F.col("spelling"))
    rows = vocabulary.select("entry", F.coalesce("cased", F.lit(False)).alias("cased"), F.size(words).alias("n"), F.array_join(words, " ").alias("said")).where("n > 0")
    rows = rows.select("entry", "cased", "n", F.when(F.col("cased"), F.col("said")).otherwise(F.lower("said")).alias("spelling"))
    return rows.groupBy("spelling", "cased", "n").agg(F.min("entry").alias("entry")).select("entry", "spelling", "cased", "n", F.xxhash64(F.lower("spelling")).alias("h"))


def runs(words: Column, lengths: list[int], apart: bool = False) -> Column:
    """Runs of so many words (pos, n, said): at every place, or side by side where they are wanted apart."""

    def of(n: int) -> Column:
        last = F.size(words) - n
        places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(n if apart else 1))).otherwise(F.slice(F.sequence(F.lit(0), F.lit(0)), 1, 0))
        return F.transform(places, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.array_join(F.slice(words, i + 1, n), " ").alias("said")))

    return F.concat(*[of(n) for n in lengths])


def spans(docs: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """docs -> doc, pos (word the span begins with, from 0), n (words), entry, said: spans of the vocabulary, overlaps included.

    Every run of as many words as some spelling has is hashed inside its row
    and joined with the vocabulary by hash; the words themselves are compared
    afterwards. The vocabulary is broadcast while its size allows.
    """
    voc = written(entries(vocabulary), "vocabulary")
    lengths = sorted(r.n for r in voc.select("n").distinct().collect())  # as many as there are lengths of spellings
    if not lengths:
        return docs.select(F.col(key).alias("doc"), F.lit(0).alias("pos"), F.lit(1).alias("n"), F.lit(None).cast("string").alias("entry"), F.lit("").alias("said")).limit(0)

    rows = docs.select(F.col(key).alias("doc"), F.explode(F.transform(F.array(said_words(F.col(text))), lambda w: runs(w, lengths)).getItem(0)).alias("r")).select("doc", "r.*", F.xxhash64(F.lower("r.said")).alias("h"))
    found = rows.join(F.broadcast(voc) if small_enough(voc, MOST_BROADCAST) else voc, ["h", "n"])
    found = found.where(F.when(F.col("cased"), F.col("said")).otherwise(F.lower("said")) == F.col("spelling"))
    # a spelling may stand in the vocabulary as it is and regardless of case: the exact one counts
    first = found.groupBy("doc", "pos", "n").agg(F.min(F.struct((~F.col("cased")).alias("loose"), "entry", "said")).alias("b"))
    return first.select("doc", "pos", "n", "b.entry", "b.said")


def segmented(found: DataFrame) -> DataFrame:
    """spans -> those that remain when a text is read from left to right and the longest span at a place is taken whole.

    Only the longest span of a place can be taken. Overlapping spans are cut
    into islands where no span reaches over the next one's beginning, and inside
    an island one pass takes what begins behind the last one taken.
    """
    longest = found.groupBy("doc", "pos").agg(F.max(F.struct("n", "entry", "said")).alias("b")).select("doc", "pos", "b.*")
    by_place = Window.partitionBy("doc").orderBy("pos")
    reach = F.max(F.col("pos") + F.col("n")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("pos") >= F.coalesce(reach, F.lit(0)), 1).otherwise(0)).over(by_place)
    groups = longest.withColumn("island", island).groupBy("doc", "island").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "entry", "said"))).alias("s"))
    empty = F.slice("s", 1, 0)
    state = lambda end, took: F.struct(end.alias("end"), took.alias("took"))
    take = lambda acc, x: F.when(x["pos"] >= acc["end"], state(x["pos"] + x["n"], F.concat(acc["took"], F.array(x)))).otherwise(acc)
    took = F.when(F.size("s") == 1, F.col("s")).otherwise(F.aggregate("s", state(F.lit(0), empty), take, lambda acc: acc["took"]))
    return groups.select("doc", F.explode(took).alias("x")).select("doc", "x.*")
