"""Topics by collapsed Gibbs sampling: every word of every document holds a topic, and counts are merged once a sweep.

Between sweeps a document is one row (`doc`, `words` in order, `sizes`: how
often each stands there, `z`: all topics in a row). It stays where it is: the
counts of the commonest words are broadcast, those of words of one document are
its own, and only the words between travel to the documents that hold them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import written

#: Words whose counts are broadcast: the commonest.
MOST_BROADCAST = 200_000
#: Words that documents have in hand while they are sampled side by side, and how many documents make that worth while.
HELD_WORDS, LEAST_ABREAST = 1_000_000, 12


@dataclass(frozen=True)
class Prior:
    topics: int = 8
    alpha: float = 0.5
    beta: float = 0.05
    seed: int = 42


def _uniform(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each h, sizes numbers in [0, 1): a mixed counter, the same on every run and however rows are dealt."""
    n = int(sizes.sum())
    with np.errstate(over="ignore"):
        x = np.repeat(h.astype(np.uint64), sizes) + (np.arange(n, dtype=np.uint64) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _drawn(p: Prior, sweep: int) -> Column:
    """A hash for each of a document's words."""
    return F.transform("words", lambda w: F.xxhash64(F.lit(p.seed), F.lit(sweep), "doc", w)).alias("h")


def _kind(df: DataFrame) -> str:
    return df.schema["doc"].dataType.simpleString()


def documents_of(tokens: DataFrame) -> DataFrame:
    """tokens(doc, word, tf) -> doc, words, sizes: a row a document."""
    by = tokens.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("word", F.col("tf").cast("int").alias("tf")))).alias("s"))
    return by.select("doc", F.col("s.word").alias("words"), F.col("s.tf").alias("sizes"))


def counted(texts: DataFrame) -> DataFrame:
    """texts(doc, tokens) -> doc, words, sizes. Words are counted where the text is; only rows that share a doc travel. A document without words gives no row."""
    again = written(texts.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "repeated")
    if not again.isEmpty():
        texts = texts.join(again, "doc", "left_anti").unionByName(texts.join(again, "doc").groupBy("doc").agg(F.flatten(F.collect_list("tokens")).alias("tokens")))

    def run(batches):
        for b in batches:
            flat, offs = _flat(b.column("tokens"))
            code, names = _codes(flat)
            key, n = np.unique(np.repeat(np.arange(b.num_rows, dtype=np.int64), np.diff(offs)) * len(names) + code, return_counts=True)
            at = np.flatnonzero(np.diff(offs))
            ends = np.searchsorted(key, (at + 1) * len(names))
            words = names.take(pa.array(key % max(len(names), 1)))
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(at)), _nested(ends, words), _nested(ends, pa.array(n, pa.int32()))], names=["doc", "words", "sizes"])

    return texts.select("doc", "tokens").mapInArrow(run, f"doc {_kind(texts)}, words array<string>, sizes array<int>")


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All values of a list column, and where each list ends."""
    offs = column.offsets.to_numpy().astype(np.int64)
    return column.values.slice(offs[0], offs[-1] - offs[0]), offs - offs[0]


def _codes(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each word among the different words in order, and these."""
    d = flat.dictionary_encode()
    order = pc.sort_indices(d.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[d.indices.to_numpy(zero_copy_only=False)] if len(order) else np.zeros(0, np.int64), d.dictionary.take(pa.array(order))


def _nested(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), values)


def first_states(docs: DataFrame, p: Prior) -> DataFrame:
    """docs(doc, words, sizes) -> doc, words, sizes, z; written."""
    rows = docs.select("doc", "words", "sizes", _drawn(p, 0))

    def run(batches):
        for b in batches:
            sizes, ends = _flat(b.column("sizes"))
            sizes = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
            z = np.floor(_uniform(_flat(b.column("h"))[0].to_numpy(zero_copy_only=False), sizes) * p.topics).astype(np.int32)
            upto = np.r_[0, np.cumsum(sizes)][ends]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("words"), b.column("sizes"), _nested(upto[1:], pa.array(z))], names=["doc", "words", "sizes", "z"])

    return written(rows.mapInArrow(run, f"doc {_kind(rows)}, words array<string>, sizes array<int>, z array<int>"), "topics")


def word_rows(states: DataFrame) -> DataFrame:
    """states -> doc, word, z (a topic for each time the word stands there)."""
    def run(batches):
        for b in batches:
            sizes, at = _flat(b.column("sizes"))
            docs = b.column("doc").take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(at))))
            z = _nested(np.cumsum(sizes.to_numpy(zero_copy_only=False)), _flat(b.column("z"))[0])
            yield pa.RecordBatch.from_arrays([docs, _flat(b.column("words"))[0], z], names=["doc", "word", "z"])

    return states.select("doc", "words", "sizes", "z").mapInArrow(run, f"doc {_kind(states)}, word string, z array<int>")


def _states_of(state: DataFrame) -> DataFrame:
    """doc, word, z -> states."""
    by = state.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("word", "z"))).alias("s"))
    return by.select("doc", F.col("s.word").alias("words"), F.transform("s.z", lambda x: F.size(x)).alias("sizes"), F.flatten("s.z").alias("z"))


def first_topics(tokens: DataFrame, p: Prior) -> DataFrame:
    """tokens(doc, word, tf) -> doc, word, z (a topic for each time the word stands there); written."""
    return word_rows(first_states(documents_of(tokens), p))


def word_counts(states: DataFrame, p: Prior) -> DataFrame:
    """states -> word, n0, n1, ...: how often each topic holds it. A batch's documents are summed up before anything is moved."""

    def run(batches):
        for b in batches:
            sizes, _ = _flat(b.column("sizes"))
            code, names = _codes(_flat(b.column("words"))[0])
            z = _flat(b.column("z"))[0].to_numpy(zero_copy_only=False)
            n = np.bincount(np.repeat(code, sizes.to_numpy(zero_copy_only=False)) * p.topics + z, minlength=len(names) * p.topics).reshape(-1, p.topics)
            yield pa.RecordBatch.from_arrays([names, *(pa.array(n[:, i].astype(np.int64)) for i in range(p.topics))], names=["word", *(f"n{i}" for i in range(p.topics))])

    rows = states.select("words", "sizes", "z").mapInArrow(run, "word string, " + ", ".join(f"n{i} long" for i in range(p.topics)))
    return rows.groupBy("word").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(p.topics)])


def state_topics(states: DataFrame, p: Prior) -> DataFrame:
    """states -> doc, n (array: how many of its words each topic holds)."""

    def run(batches):
        for b in batches:
            z, offs = _flat(b.column("z"))
            n = np.bincount(np.repeat(np.arange(b.num_rows), np.diff(offs)) * p.topics + z.to_numpy(zero_copy_only=False), minlength=b.num_rows * p.topics)
            yield pa.RecordBatch.from_arrays([b.column("doc"), _nested(np.arange(1, b.num_rows + 1) * p.topics, pa.array(n.astype(np.int64)))], names=["doc", "n"])

    return states.select("doc", "z").mapInArrow(run, f"doc {_kind(states)}, n array<long>")


def _counts(p: Prior) -> list[Column]:
    return [F.sum(F.size(F.filter("z", _is(i)))).alias(f"n{i}") for i in range(p.topics)]


def _is(i: int):
    return lambda t: t == i


def topic_words(state: DataFrame, p: Prior) -> DataFrame:
    """state -> word, n (array: how often each topic holds it)."""
    return state.groupBy("word").agg(*_counts(p)).select("word", F.array(*[f"n{i}" for i in range(p.topics)]).alias("n"))


def document_topics(state: DataFrame, p: Prior) -> DataFrame:
    """state -> doc, n (array: how many of its words each topic holds)."""
    return state.groupBy("doc").agg(*_counts(p)).select("doc", F.array(*[f"n{i}" for i in range(p.topics)]).alias("n"))


def _totals(words: DataFrame, p: Prior) -> tuple[list[int], int]:
    """Words that each topic holds in all, and how many different words there are: one row."""
    r = words.agg(F.count("*").alias("v"), *[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(p.topics)]).first()
    return [int(r[f"n{i}"] or 0) for i in range(p.topics)], int(r.v)


def _sample(z: list[list[int]], held: list[list[int]], u: list[float], totals: list[int], size: int, p: Prior) -> list[list[int]]:
    """New topics of one document's words, one after another, each as all the others stand at that time."""
    k, doc, all_ = range(p.topics), [0] * p.topics, list(totals)
    for x in z:
        for t in x:
            doc[t] += 1
    out, at, beta_all = [], 0, p.beta * size
    for old, word in zip(z, held):
        word, new = list(word), []
        for t in old:
            doc[t] -= 1
            word[t] -= 1
            all_[t] -= 1
            upto, s = [], 0.0
            for i in k:
                s += (doc[i] + p.alpha) * (word[i] + p.beta) / (all_[i] + beta_all)
                upto.append(s)
            x, t, at = u[at] * s, 0, at + 1
            while upto[t] < x:
                t += 1
            doc[t] += 1
            word[t] += 1
            all_[t] += 1
            new.append(t)
        out.append(new)
    return out


def _abreast(z: np.ndarray, size: np.ndarray, starts: np.ndarray, held: np.ndarray, u: np.ndarray, totals: list[int], words: int, p: Prior) -> np.ndarray:
    """`_sample` of many documents at once, with the same draws: document i has the words starts[i] to starts[i + 1], size times each; held is a row a word.

    Documents know nothing of each other in a sweep, so all take their first
    place together, then their second and so on, longest first. What is left of
    the few longest ones is done by `_sample`.
    """
    k, ends = p.topics, np.r_[0, np.cumsum(size)]
    at, n = ends[starts[:-1]], ends[starts[1:]] - ends[starts[:-1]]
    word = np.repeat(np.arange(len(size)), size)
    doc = np.bincount(np.repeat(np.arange(len(n)), n) * k + z, minlength=len(n) * k).reshape(-1, k).astype(np.float64)
    every = np.tile(np.array(totals, np.float64), (len(n), 1))
    out, held, beta_all = z.copy(), held.astype(np.float64), p.beta * words
    order = np.argsort(-n, kind="stable")
    at, n, doc = at[order], n[order], doc[order]
    steps = int(n[LEAST_ABREAST - 1]) if len(n) >= LEAST_ABREAST else 0
    long = int(np.searchsorted(-n, -steps, "left")) if steps else len(n)  # documents of more places than that
    for j in range(long):
        i = order[j]
        own = range(starts[i], starts[i + 1])
        new = _sample([z[ends[w] : ends[w + 1]].tolist() for w in own], held[starts[i] : starts[i + 1]].tolist(), u[at[j] : at[j] + n[j]].tolist(), totals, words, p)
        out[at[j] : at[j] + n[j]] = [t for x in new for t in x]
    at, n, doc, every = at[long:], n[long:], doc[long:], every[long:]
    row, live = np.arange(len(n)), len(n)
    for step in range(steps):
        live = int(np.searchsorted(-n[:live], -step, "left"))  # those of more than step places
        if not live:
            break
        r, i = row[:live], at[:live] + step
        w, old = word[i], z[i]
        doc[r, old] -= 1
        held[w, old] -= 1
        every[r, old] -= 1
        upto = np.cumsum((doc[:live] + p.alpha) * (held[w] + p.beta) / (every[:live] + beta_all), axis=1)
        new = (upto < (u[i] * upto[:, -1])[:, None]).sum(axis=1)
        doc[r, new] += 1
        held[w, new] += 1
        every[r, new] += 1
        out[i] = new
    return out


def _bar(words: DataFrame, most: int) -> tuple[int, bool]:
    """The least number so that at most `most` words(whole) are above it, and whether others are left."""
    cap = 10_000  # so few rows come to the driver at most
    rows = words.groupBy(F.least("whole", F.lit(cap)).alias("whole")).count().orderBy(F.desc("whole")).collect()
    for r in rows:
        most -= r["count"]
        if most < 0:
            return (r.whole if r.whole < cap else (1 << 62)), True
    return 0, False


def sweep_states(states: DataFrame, p: Prior, turn: int, most_broadcast: int | None = None) -> DataFrame:
    """states with every topic drawn anew; written.

    Documents see the counts of the sweep before. A word that stands in one
    document only has no counts but its own; of the others the commonest are
    broadcast, and the counts of the rest go to the documents that hold them.
    """
    most = MOST_BROADCAST if most_broadcast is None else most_broadcast
    k, names = p.topics, [f"n{i}" for i in range(p.topics)]
    words = written(word_counts(states, p), "topic_words")
    totals, size = _totals(words.select("word", F.array(*names).alias("n")), p)
    words = words.withColumn("whole", sum((F.col(x) for x in names[1:]), F.col(names[0]))).where("whole > 1")
    bar, some_left = _bar(words, most)
    common = words.where(F.col("whole") > bar)
    top = common.select("word", *names).toArrow()
    theirs = np.stack([top.column(x).to_numpy() for x in names], axis=1).astype(np.int64)
    shared = states.sparkSession.sparkContext.broadcast((top.column("word").combine_chunks(), theirs))
    rows = states.select("doc", "words", "sizes", "z", _drawn(p, turn))
    if some_left:
        own = states.select("doc", F.explode(F.arrays_zip("words", "sizes")).alias("w")).select("doc", F.col("w.words").alias("word"), F.col("w.sizes").alias("size"))
        own = own.join(F.broadcast(common.select("word")), "word", "left_anti")
        own = own.join(words.where(F.col("whole") <= bar), "word").where("size < whole")
        own = own.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("word", F.array(*names).alias("n")))).alias("rest"))
        rows = rows.join(own, "doc", "left")
    else:
        rows = rows.withColumn("rest", F.lit(None).cast("array<struct<word:string,n:array<bigint>>>"))

    def run(batches):
        known, theirs = shared.value
        for b in batches:
            for a, o in _parts(b.column("sizes")):
                yield done(b.slice(a, o - a), known, theirs)

    def done(b, known, theirs):
        names, starts = _flat(b.column("words"))
        n = _flat(b.column("sizes"))[0].to_numpy(zero_copy_only=False).astype(np.int64)
        z = _flat(b.column("z"))[0].to_numpy(zero_copy_only=False).astype(np.int64)
        held = np.bincount(np.repeat(np.arange(len(n)), n) * k + z, minlength=len(n) * k).reshape(-1, k)
        at = pc.index_in(names, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
        held[at >= 0] = theirs[at[at >= 0]]
        rest = b.column("rest")
        if rest.null_count < len(rest):
            full = rest.drop_null()
            many = np.diff(full.offsets.to_numpy())
            which = np.flatnonzero(rest.is_valid().to_numpy(zero_copy_only=False))
            given, _ = _flat(full)
            # words of a document are in order in both, so each is found by its document and its place among all words
            code, _all = _codes(pa.concat_arrays([names, given.field("word")]))
            key = np.r_[np.repeat(np.arange(len(b)), np.diff(starts)), np.repeat(which, many)] * len(_all) + code
            held[np.searchsorted(key[: len(names)], key[len(names) :])] = _flat(given.field("n"))[0].to_numpy(zero_copy_only=False).reshape(-1, k)
        u = _uniform(_flat(b.column("h"))[0].to_numpy(zero_copy_only=False), n)
        new = _abreast(z, n, starts, held, u, totals, size, p)
        return pa.RecordBatch.from_arrays([b.column("doc"), b.column("words"), b.column("sizes"), _nested(_flat(b.column("z"))[1][1:], pa.array(new, pa.int32()))], names=["doc", "words", "sizes", "z"])

    return written(rows.mapInArrow(run, f"doc {_kind(rows)}, words array<string>, sizes array<int>, z array<int>"), "topics")


def _parts(sizes: pa.ListArray):
    """Stretches of documents of HELD_WORDS words in all, or of one document."""
    flat, offs = _flat(sizes)
    upto = np.r_[0, np.cumsum(flat.to_numpy(zero_copy_only=False).astype(np.int64))][offs]
    a = 0
    while a < len(sizes):
        o = max(a + 1, int(np.searchsorted(upto, upto[a] + HELD_WORDS, "right")) - 1)
        yield a, o
        a = o


def sweep(state: DataFrame, p: Prior, turn: int) -> DataFrame:
    """state(doc, word, z) with every topic drawn anew."""
    return word_rows(sweep_states(written(_states_of(state), "states"), p, turn))


def sampled_states(docs: DataFrame, p: Prior = Prior(), sweeps: int = 4) -> DataFrame:
    """docs(doc, words, sizes) -> states after so many sweeps.

    All words count, however rare or common. Documents of a task see the
    counts of the sweep before for words elsewhere, so results do not depend
    on how rows are dealt, and reruns agree. Each sweep is written, so a lost
    executor repeats a part of one sweep.
    """
    states = first_states(docs, p)
    for turn in range(1, sweeps + 1):
        states = sweep_states(states, p, turn)
    return states


def sampled(tokens: DataFrame, p: Prior = Prior(), sweeps: int = 4) -> DataFrame:
    """tokens(doc, word, tf) -> doc, word, z after so many sweeps, as `sampled_states` does them."""
    return word_rows(sampled_states(documents_of(tokens), p, sweeps))


def held_out_score(state: DataFrame, tokens: DataFrame, p: Prior, rounds: int = 20) -> float:
    """Mean log likelihood of words of new documents: half of a document's different words tell its topics, the other half are scored. Words that no topic knows are left out."""
    words = topic_words(state, p)
    totals, size = _totals(words, p)
    half = F.pmod(F.xxhash64("word"), F.lit(2)) == 0
    rows = tokens.join(words, "word").select("doc", "word", "tf", "n", half.alias("half")).repartition("doc").sortWithinPartitions("doc", "word")
    base = np.array(totals) + p.beta * size

    def score(x):
        tf, half, phi = x["tf"].to_numpy(), x["half"].to_numpy(), (np.stack(x["n"]) + p.beta) / base
        theta = np.full(p.topics, 1 / p.topics)
        for _ in range(rounds):
            r = phi[half] * theta
            theta = (tf[half, None] * r / np.maximum(r.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0) + p.alpha
            theta /= theta.sum()
        told = tf[~half] * np.log(phi[~half] @ theta)
        return x[["doc"]].iloc[:1].assign(score=float(told.sum()), words=float(tf[~half].sum()))

    r = rows.groupBy("doc").applyInPandas(score, f"doc {_kind(rows)}, score double, words double").agg(F.sum("score").alias("s"), F.sum("words").alias("n")).first()
    return r.s / r.n if r.n else 0.0


def entropy(counts: Column, alpha: float, topics: int) -> Column:
    """Entropy of a document's topics, as its counts and the prior have them."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x) + alpha * topics
    return -F.aggregate(counts, F.lit(0.0), lambda s, x: s + (x + alpha) / total * F.log((x + alpha) / total))
