"""Gibbs sampling: counts are conserved, reruns agree, and new documents become likelier."""

import random

from pyspark.sql import functions as F

from brindle.operators import topics
from brindle.operators.corpus import terms
from brindle.session import table

SCHEMA = "doc long, word string, tf long"


def two_subjects(spark, first, n):
    """Documents that speak of one of two subjects, with words of their own."""
    rng = random.Random(first)
    rows = []
    for doc in range(first, first + n):
        words = [f"{'ab'[doc % 2]}{min(rng.randrange(30), rng.randrange(30))}" for _ in range(40)] + [f"common{rng.randrange(5)}" for _ in range(10)] + [f"own{doc}"]
        rows += [(doc, w, words.count(w)) for w in set(words)]
    return spark.createDataFrame(rows, SCHEMA)


def test_counts_are_conserved_and_reruns_agree(spark):
    p = topics.Prior(topics=3)
    tokens = two_subjects(spark, 0, 40)
    state = topics.sampled(tokens, p, 2)
    assert {(r.doc, r.word): r.n for r in state.select("doc", "word", F.size("z").alias("n")).collect()} == {(r.doc, r.word): r.tf for r in tokens.collect()}
    total = tokens.agg(F.sum("tf")).first()[0]
    for counts in (topics.topic_words(state, p), topics.document_topics(state, p)):
        assert sum(sum(r.n) for r in counts.collect()) == total
    again = topics.sampled(tokens.repartition(7), p, 2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, state.collect()))
    assert topics.sampled(tokens.limit(0), p, 1).count() == 0


def test_topics_become_the_subjects(spark):
    p = topics.Prior(topics=2, alpha=0.1)
    tokens, new = two_subjects(spark, 0, 60), two_subjects(spark, 1000, 20)
    state = topics.first_topics(tokens, p)
    scores = [topics.held_out_score(state, new, p)]
    for turn in range(1, 13):
        state = topics.sweep(state, p, turn)
        if turn in (4, 12):
            scores.append(topics.held_out_score(state, new, p))
    assert scores[0] < scores[1] < scores[2] + 0.02 and scores[2] > scores[0] + 0.2
    subject = {r.doc: max(range(2), key=lambda i: r.n[i]) for r in topics.document_topics(state, p).collect()}
    assert len({(d % 2, t) for d, t in subject.items()}) == 2  # each subject has one topic


def test_held_out_documents_of_the_table_become_likelier(spark, sf):
    p = topics.Prior()
    tokens = terms(table(spark, sf, "documents"), "doc_id", "text").select(F.col("key").alias("doc"), F.col("term").alias("word"), "tf")
    seen, new = tokens.where("doc % 5 > 0"), tokens.where("doc % 5 = 0")
    state = topics.first_topics(seen, p)
    before = topics.held_out_score(state, new, p)
    for turn in range(1, 5):
        state = topics.sweep(state, p, turn)
    assert topics.held_out_score(state, new, p) > before + 0.05


def test_documents_abreast_are_sampled_as_one_by_one():
    import numpy as np

    rng, p, vocabulary = np.random.default_rng(3), topics.Prior(topics=4), 50
    theirs = rng.integers(5, 60, (vocabulary, 4))
    words = [np.sort(rng.choice(vocabulary, n, replace=False)) for n in [*rng.integers(1, 30, 40), 0, 50, 50]]
    starts = np.r_[0, np.cumsum([len(w) for w in words])]
    size = rng.integers(1, 4, starts[-1])
    ends = np.r_[0, np.cumsum(size)]
    z, u, held = rng.integers(0, 4, ends[-1]), rng.random(ends[-1]), theirs[np.concatenate(words)]
    totals = (theirs.sum(axis=0) + 1000).tolist()
    want = []
    for a, b in zip(starts, starts[1:]):
        new = topics._sample([z[ends[w] : ends[w + 1]].tolist() for w in range(a, b)], held[a:b].tolist(), u[ends[a] : ends[b]].tolist(), totals, vocabulary, p)
        want += [t for x in new for t in x]
    assert topics._abreast(z, size, starts, held, u, totals, vocabulary, p).tolist() == want


def test_counts_reach_words_that_are_not_broadcast(spark):
    p, tokens = topics.Prior(topics=3), two_subjects(spark, 0, 40)
    states = topics.first_states(topics.documents_of(tokens), p)
    want = sorted(map(tuple, topics.sweep_states(states, p, 1).collect()))
    for most in (1, 7, 33):
        assert sorted(map(tuple, topics.sweep_states(states, p, 1, most).collect())) == want


def test_words_are_counted_in_their_rows(spark):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["é", "z", "a"]), (1, ["c", "b"]), (None, ["x"])]
    got = topics.counted(spark.createDataFrame(rows, "doc long, tokens array<string>").coalesce(1)).collect()
    assert sorted((r.doc or 0, r.words, r.sizes) for r in got) == [(0, ["x"], [1]), (1, ["a", "b", "c"], [1, 3, 1]), (4, ["a", "z", "é"], [1, 1, 1])]
