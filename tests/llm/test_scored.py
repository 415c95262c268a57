"""Scored operators: held-out accuracy on the labelled tables, and odd inputs."""

import pytest

from brindle.llm import language, quality, toxicity
from brindle.session import table

SF = "/root/testdata/sf0.01"
#: Held-out accuracy is asked for where there are thousands of labels.
LABELLED = "/root/testdata/sf0.1"
ODD = [(1, None, "x"), (2, "", "x"), (3, "word " * 60000, "x"), (4, "12 34 !!", "x"), (4, "12 34 !!", "x"), (None, "hello there", "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score string")


def accuracy(got, labels, label):
    from pyspark.sql import functions as F

    lab = labels.groupBy("doc_id").agg(F.max(label).alias("label"))
    rows = got.join(lab, "doc_id").where(F.col("held_out")).collect()
    assert rows
    return sum(r.predicted == r.label for r in rows) / len(rows)


@pytest.mark.parametrize("op,label", [(quality.op2, "quality"), (toxicity.op3, "toxic")])
def test_held_out_accuracy(spark, op, label):
    got = op(spark, LABELLED).cache()
    assert got.count() == table(spark, LABELLED, "documents").count()
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert accuracy(got, table(spark, LABELLED, "labels"), label) >= 0.95


def test_language_held_out(spark):
    got = language.op8(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.95


def test_odd_inputs_give_one_row_each(spark, odd):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert quality.score_quality(odd, quality.fitted(docs, labels)).count() == len(ODD)
    assert toxicity.score_texts(odd, toxicity.fitted(docs, labels)).count() == len(ODD)
    got = {r.doc_id: r for r in language.identify(odd, language.fitted(docs)).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[4].lang_pred == "und" and got[1].score == 0.0
    none = odd.limit(0)
    assert quality.score_quality(none, quality.fitted(docs, labels)).count() == 0
    assert quality.fit([]).score is not None and toxicity.fit([]).weights == {} and language.fit([]).langs == []


def test_lexicon_folds_disguises_and_excuses_phrases():
    rows = [(f"you w{k} moron z{k} today", 1) for k in range(80)] + [(f"fine day {k} for a walk", 0) for k in range(200)]
    lex = toxicity.fit(rows)
    assert "moron" in lex.weights
    auto = lex.automaton()
    assert toxicity.found(toxicity.fold("M0R0N"), auto) > 0
    assert toxicity.found(toxicity.fold("mоrоn"), auto) > 0  # Cyrillic о
    assert toxicity.found(toxicity.fold("moronic"), auto) == 0
    lex.excused = ("moron island",)
    assert toxicity.found("moron island", lex.automaton()) == 0


def test_forward_backward_is_the_sum_over_all_paths():
    import itertools

    import numpy as np

    from brindle.llm import crf

    rng = np.random.default_rng(2)
    lengths = np.array([4, 0, 1, 3])
    starts = np.cumsum(lengths) - lengths
    for labels in (2, 3):
        emit, trans, first = rng.normal(0, 2, (8, labels)), rng.normal(0, 1, (labels, labels)), rng.normal(0, 1, labels)
        want, pair, logz, opening = np.zeros((8, labels)), np.zeros((labels, labels)), 0.0, np.zeros(labels)
        for a, n in zip(starts, lengths):
            paths = list(itertools.product(range(labels), repeat=int(n))) if n else []
            weight = np.array([np.exp(first[p[0]] + sum(emit[a + i, y] for i, y in enumerate(p)) + sum(trans[x, y] for x, y in zip(p, p[1:]))) for p in paths])
            if n:
                logz += np.log(weight.sum())
            for p, w in zip(paths, weight / weight.sum() if n else []):
                opening[p[0]] += w
                for i, y in enumerate(p):
                    want[a + i, y] += w
                for x, y in zip(p, p[1:]):
                    pair[x, y] += w
        got, xi, z, pf = crf.forward_backward(emit, starts, lengths, trans, first, pairs=True)
        assert np.allclose(got, want) and np.allclose(xi, pair) and np.isclose(z, logz) and np.allclose(pf, opening)


def test_automaton_finds_what_plain_search_finds():
    import random
    import re

    rng = random.Random(4)
    lex = toxicity.Lexicon({"ab": 1.0, "abc": 2.0, "b c": 4.0, "ca": 8.0}, ("ab c", "c ab ca", "zz"), 0, 0, 0)
    auto = lex.automaton()
    for _ in range(400):
        text = "".join(rng.choice("abc  .") for _ in range(rng.randrange(30)))
        spans = lambda w: [m.start() for m in re.finditer(f"(?={re.escape(w)})", text) if not (text[: m.start()][-1:].isalnum() or text[m.start() + len(w) :][:1].isalnum())]
        out = [(s, s + len(p)) for p in lex.excused for s in spans(p)]
        want = sum(x for w, x in lex.weights.items() for s in spans(w) if not any(a <= s and s + len(w) <= b for a, b in out))
        assert toxicity.found(text, auto) == want


def test_a_text_full_of_terms_and_exceptions_costs_its_length():
    import time

    auto = toxicity.Lexicon({"clown": 1.0}, ("clown fish",), 0, 0, 0).automaton()
    text = "clown fish and clown " * 500_000
    began = time.perf_counter()
    assert toxicity.found(toxicity.fold(text), auto) == 500_000
    assert time.perf_counter() - began < 60


def test_toxic_rows_go_whatever_the_columns_are_called(spark):
    lex = toxicity.Lexicon({"moron": 3.0}, (), -4.0, 6.0, 0.0)
    rows = [(1, "you moron", 0.5, 1, "x"), (2, "fine", None, None, None), (None, None, 1.0, 2, "y"), (2, "fine", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tox_score double, Tox_Weight int, _text string")
    assert sorted((r.doc_id or -1, r.tox_score) for r in toxicity.without_toxic(df, lex).collect()) == [(-1, 1.0), (2, None), (2, None)]
    assert toxicity.without_toxic(df.limit(0), lex).columns == df.columns


def test_fitting_rows_are_bounded_and_alike_on_every_run(spark):
    from pyspark.sql import functions as F

    from brindle.llm.samples import bounded, labelled_texts

    docs = spark.range(3000).select((F.col("id") % 700).alias("doc_id"), F.concat(F.lit("text "), F.col("id"), F.repeat(F.lit("x"), F.when(F.col("id") % 11 == 0, 9000).otherwise(20))).alias("text"))
    one = [tuple(r) for r in bounded(docs, 500, 40_000)]
    assert one == [tuple(r) for r in bounded(docs.repartition(3), 500, 40_000)]
    assert 0 < sum(len(t) for _, t in one) <= 40_000 and len(one) <= 500 and max(len(t) for _, t in one) <= 2500
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    assert len(labelled_texts(docs, labels, "quality", 5, 0, 100)) <= 100
    assert bounded(docs.limit(0), 10) == [] and labelled_texts(docs, labels.limit(0), "quality", 5, 0, 100) == []


def test_words_of_code_switched_text_are_labelled(spark):
    docs = table(spark, LABELLED, "documents")
    field = language.fitted(docs)
    from brindle.llm.samples import fold_of
    from pyspark.sql import functions as F

    held = docs.where((fold_of(F.col("doc_id"), 4) == 2) & F.col("lang").isNotNull() & (F.length("text") > 600)).limit(400).collect()
    by = {}
    for r in held:
        by.setdefault(r.lang, []).append(r.text[:500].replace("\n", " "))
    mixed = [(a[0] + ". " + b[0] + ". " + a[1], x) for x, a in by.items() for y, b in by.items() if x != y and len(a) > 1]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(mixed)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.identify(df, field).collect()}
    assert sum(got[i] == x for i, (_, x) in enumerate(mixed)) >= 0.9 * len(mixed)
