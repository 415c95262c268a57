"""Keyword search: two words of a question lead to the places where it can match, and what stands around them decides, inside the document."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import permutations, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import small_enough, written

# A word (letters and digits, dots between them, one dot before, + and # behind), words that may stand
# between a keyword's words in a title, and words shown on either side of a hit.
WORD = r"\.?[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*[+#]*"
NEAR, CONTEXT = 2, 2
TITLE = 0
#: Rows that are broadcast at most, different questions that a task looks for, and hits that it returns at a time.
MOST_BROADCAST, ASKS, HITS = 100_000, 50_000, 20_000
_WORDS = re.compile(WORD).findall


def said_words(text: Column) -> Column:
    """Words of a text as they are said, in order; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def forms(word: str) -> tuple[str, str, str]:
    """A word as written and its plurals."""
    return word, f"{word}s", f"{word}es"


def fields_read(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """docs -> doc and its fields (columns _0, _1 ...), dealt out once by key, as text, so that all that is found in one is found where it lies.

    Searching costs far more than its bytes tell, so the parts are not merged by their size.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return docs.select(F.col(key).alias("doc"), *[F.col(f).alias(f"_{i}") for i, f in enumerate(fields)]).repartition(parts, "doc")


def parsed(questions: DataFrame, key: str, text: str) -> DataFrame:
    """questions -> question, words (lower case, in order) of those that hold a word."""
    return questions.select(F.col(key).alias("question"), F.transform(said_words(F.col(text)), F.lower).alias("words")).where(F.size("words") > 0)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small_enough(df, MOST_BROADCAST) else df


class _Asks:
    """Different lists of words, each under what leads to it: its one word, two of its words that follow each other, and two that stand near each other, in all their forms.

    The two words are those that questions use least. `low` is a field's words
    in lower case, `known` the asks that need no answer any more.
    """

    def __init__(self, asks: list[list[str]], near: int) -> None:
        uses = Counter(w for a in asks for w in a)
        shapes = {w: frozenset(forms(w)) for w in uses}
        rare = lambda *words: (math.prod(uses[w] for w in words), words)
        self.near, self.reach, self.asks = near, max(map(len, asks), default=0) + near, [[shapes[w] for w in a] for a in asks]
        self.single: dict[str, list[int]] = defaultdict(list)
        self.pairs: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
        self.close: dict[tuple[str, str], list[int]] = defaultdict(list)
        for n, a in enumerate(asks):
            if len(a) == 1:
                for x in shapes[a[0]]:
                    self.single[x].append(n)
                continue
            k = min(range(len(a) - 1), key=lambda k: rare(a[k], a[k + 1]))
            for both in product(shapes[a[k]], shapes[a[k + 1]]):
                self.pairs[both].append((n, k))
            two = sorted(set(a), key=rare)[:2]
            for both in {x for u, v in permutations((two[0], two[-1])) for x in product(shapes[u], shapes[v])}:
                self.close[both].append(n)

    def phrases(self, low: list[str], known: dict) -> dict[int, tuple[int, int]]:
        """ask -> first, last of the first place where its words stand in order."""
        found: dict[int, tuple[int, int]] = {}
        first = dict(zip(reversed(low), range(len(low) - 1, -1, -1)))
        for x in self.single.keys() & first.keys():
            for n in self.single[x]:
                if n not in known:
                    found[n] = min(found.get(n, (len(low), 0)), (first[x], first[x]))
        for i, here in enumerate(map(self.pairs.get, zip(low, low[1:]))):
            for n, k in here or ():
                at, q = i - k, self.asks[n]
                if at >= 0 and n not in known and n not in found and at + len(q) <= len(low) and all(x in w for x, w in zip(low[at : at + len(q)], q)):
                    found[n] = (at, at + len(q) - 1)
        return found

    def nearest(self, low: list[str], known: dict) -> dict[int, tuple[int, int]]:
        """ask -> first, last of the shortest stretch that holds all its words, in any order, with at most `near` words more, the earliest of several. A word may count for several of an ask's."""
        best: dict[int, tuple[int, int]] = {}
        for apart in range(self.reach):
            for i, here in enumerate(map(self.close.get, zip(low, low[apart:]))):
                for n in here or ():
                    q, longest = self.asks[n], len(self.asks[n]) + self.near
                    for at in range(max(0, i + apart - longest + 1), i + 1) if n not in known else ():
                        if any(low[at] in w for w in q):  # a shortest stretch begins with a word of the ask
                            part = low[at : at + longest]
                            d = max(next((e for e, x in enumerate(part) if x in w), longest) for w in q)
                            if d < longest:
                                best[n] = min(best.get(n, (longest, 0)), (d, at))
        return {n: (at, at + d) for n, (d, at) in best.items()}

    def hits(self, fields: list[str | None]) -> Iterator[tuple[int, int, bool, int, int, str, str, str]]:
        """ask, field, whether near only, first, last, before, match, after: a document's answer to each ask that it answers."""
        known: dict[int, tuple[int, int]] = {}
        for f, text in enumerate(fields):
            said = _WORDS(text or "")
            low = [*map(str.lower, said)]
            for late in (False, True) if f == TITLE else (False,):
                found = self.nearest(low, known) if late else self.phrases(low, known)
                known |= found
                for n, (first, last) in found.items():
                    yield n, f, late, first, last, *_in_context(said, first, last)


def _in_context(said: list[str], first: int, last: int, around: int = CONTEXT) -> tuple[str, str, str]:
    """before, match, after: words as said, with … where the field goes on."""
    before, after = " ".join(said[max(first - around, 0) : first]), " ".join(said[last + 1 : last + 1 + around])
    return "… " + before if first > around else before, " ".join(said[first : last + 1]), after + " …" if last + around + 1 < len(said) else after


def _hits(read: DataFrame, asks: DataFrame, near: int) -> DataFrame:
    """read, asks(ask, words) -> ask, doc, field, late, first, last, before, match, after."""
    fields, asked = [c for c in read.columns if c != "doc"], asks.toArrow()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names = _Asks(asked.column("words").to_pylist(), near), asked.column("ask").combine_chunks()

        def batch(docs: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            doc, ask, *rest = zip(*rows)
            kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([names.take(pa.array(ask)), docs.take(pa.array(doc)), *(pa.array(v, t) for v, t in zip(rest, kinds))], names=["ask", "doc", "field", "late", "first", "last", "before", "match", "after"])

        for x in batches:
            rows: list[tuple] = []
            for i in range(len(x)):
                rows += [(i, *hit) for hit in index.hits([x.column(f)[i].as_py() for f in fields])]
                if len(rows) >= HITS:
                    yield batch(x.column("doc"), rows)
                    rows = []
            if rows:
                yield batch(x.column("doc"), rows)

    ask, doc = asks.schema["ask"].dataType.simpleString(), read.schema["doc"].dataType.simpleString()
    return read.mapInArrow(run, f"ask {ask}, doc {doc}, field int, late boolean, first int, last int, before string, match string, after string")


def find_keywords(docs: DataFrame, key: str, fields: list[str], questions: DataFrame, q_key: str, q_text: str, near: int = NEAR) -> DataFrame:
    """Where documents say what questions ask: question, doc, field, kind (phrase or near), first, last, before, match, after.

    A question matches where its words stand in order as whole words, plurals
    allowed, and in the title (the first field) also where they stand near each
    other. A document answers once: by its title, as a phrase before nearness,
    then by its other fields in order. Questions without a word, and null
    texts, match nothing; documents and questions must have distinct keys.

    Questions of the same words are searched for once, under the least of them,
    and told apart at the end. They travel to the tasks, in blocks where they
    are many. Only the texts are dealt out, so what is moved grows with them
    and not with the hits.
    """
    read, every = fields_read(docs, key, fields), written(parsed(questions, q_key, q_text), "questions")
    asks = written(every.groupBy("words").agg(F.min("question").alias("ask")), "asks")
    blocks = max(1, -(-asks.count() // ASKS))
    parts = [asks.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == i).select("ask", "words") for i in range(blocks)]
    found = reduce(DataFrame.unionByName, [_hits(read, part, near) for part in parts])
    names = written(every.join(asks, "words").select("ask", "question"), "names")
    kind = F.when(F.col("late"), "near").otherwise("phrase").alias("kind")
    return found.join(_few(names), "ask").select("question", "doc", "field", kind, "first", "last", "before", "match", "after")


def top_passages(docs: DataFrame, key: str, text: str, pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """pairs(question, doc), terms(question, word) -> question, doc, held (different terms of the question in the document), first, last: the shortest stretch that holds all of them, the earliest of several.

    The documents are those that a search has put in front, and the terms those
    that it looked for, a few a question. Two pointers walk a document's hits
    once: a stretch ends at a hit and begins at the earliest of the last places
    of all terms so far, and these last places are running maxima. Pairs
    without a hit give no row.
    """
    asked = _few(pairs.select("question", "doc").distinct())
    wanted = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).join(_few(pairs.select("doc").distinct()), "doc", "left_semi")
    words = wanted.select("doc", F.posexplode(F.transform(said_words(F.col("text")), F.lower)).alias("pos", "word"))
    hits = words.join(_few(terms.select("question", "word").distinct()), "word").join(asked, ["question", "doc"])
    by_doc = Window.partitionBy("question", "doc")
    hits = hits.withColumn("w", F.dense_rank().over(by_doc.orderBy("word"))).withColumn("held", F.max("w").over(by_doc))
    each = hits.select("question", "doc", "pos", "w", "held", F.explode(F.sequence(F.lit(1), F.col("held"))).alias("i"))
    so_far = Window.partitionBy("question", "doc", "i").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("at", F.max(F.when(F.col("w") == F.col("i"), F.col("pos"))).over(so_far))
    ends = each.groupBy("question", "doc", "held", "pos").agg(F.count("at").alias("n"), F.min("at").alias("first")).where("n = held")
    best = ends.groupBy("question", "doc", "held").agg(F.min(F.struct((F.col("pos") - F.col("first")).alias("d"), "first", F.col("pos").alias("last"))).alias("b"))
    return best.select("question", "doc", F.col("held").cast("long").alias("held"), F.col("b.first").alias("first"), F.col("b.last").alias("last"))
