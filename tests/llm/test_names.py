"""Stages and scores on tables with clashing or dotted column names, null, empty, repeated and no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from brindle.llm import chat, decontaminate, language, media, near, pii, quality, toxicity
from brindle.session import table

TEXTS = [
    (1, "Write to jane.roe@example.org or 10.0.0.1 about the plan that we made for the spring."),
    (1, "Write to jane.roe@example.org or 10.0.0.1 about the plan that we made for the spring."),
    (2, "write to jane.roe@example.org or 10.0.0.1 about the plan that we made for the spring."),
    (3, None),
    (4, ""),
    (None, "A row without a number stays, whoever calls +44 20 7946 0958 for it today."),
    (None, None),
    (5, "word " * 30_000),
]
#: Names that the stages use inside.
ODD = ("_pii", "_pii_text", "_pii_spans", "_bad", "_gone", "_text", "_row", "_new", "_k0", "_k1", "tox_score", "tox_weight", "score", "lang_pred", "node", "a.b", "first", "n_bytes")


def odd(spark):
    docs = spark.createDataFrame([(i, t, "en", "s" if i else None, len(t) if t else None) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(ODD)])


def stages(spark, sf):
    docs, labels, items = (table(spark, sf, t) for t in ("documents", "labels", "benchmark"))
    return {
        "toxicity": lambda x: toxicity.without_toxic(x, toxicity.fitted(docs, labels)),
        "near": near.one_of_each,
        "decontaminate": lambda x: decontaminate.clean(x, items),
        "pii": lambda x: pii.without_pii(x, pii.fitted(docs)),
        "mixing": cp.mixing.mixed_documents,
    }


@pytest.mark.parametrize("name", ["toxicity", "near", "decontaminate", "pii", "mixing"])
def test_stages_bear_any_names_and_rows(spark, sf, name):
    stage, docs = stages(spark, sf)[name], odd(spark)
    out = stage(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    values = {tuple(r[5:]) for r in rows}
    assert values == {tuple(range(len(ODD)))}
    assert stage(docs.limit(0)).collect() == []
    if name == "near":
        assert sorted(str(r.doc_id) for r in rows) == ["1", "3", "5", "None", "None"]  # empty texts are alike, rows without a number stay
    elif name == "pii":
        assert [r.text for r in rows].count("Write to [EMAIL] or [IP] about the plan that we made for the spring.") == 2
        assert sum(r.text is None for r in rows) == 2 and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    elif name != "mixing":
        assert len(rows) == len(TEXTS)


def test_scores_bear_any_names(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    keep = ("doc_id", *ODD)
    for out, more in (
        (quality.score_quality(odd(spark), quality.fitted(docs, labels), keep), ["score_"]),
        (language.identify(odd(spark), language.fitted(docs), keep), ["lang_pred_", "score_"]),
        (pii.find_pii(odd(spark), None, keep), ["_pii_text_", "_pii_base", "_pii_spans_"]),
    ):
        assert out.columns == [*keep, *more]
        assert len(out.collect()) == len(TEXTS)


def test_whole_pipeline_on_odd_tables(spark, sf, tmp_path):
    """Null, empty, repeated and clashing rows through all stages, and an empty table."""
    for name, rows in (("odd", odd(spark)), ("none", odd(spark).limit(0)), ("twice", odd(spark).union(odd(spark)))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for t in ("labels", "benchmark"):
            table(spark, sf, t).write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        out = cp.run(spark, f"{tmp_path}/{name}")
        assert out.columns == rows.columns
        got = out.collect()
        if name == "none":
            assert got == []
        else:
            assert got and all(tuple(r[5:]) == tuple(range(len(ODD))) for r in got)
            assert not any("@" in (r.text or "") or "7946" in (r.text or "") for r in got)


def test_media_and_chat_of_no_rows_and_repeated_rows(spark):
    docs = odd(spark)
    images = media.to_media(docs, ("doc_id",)).where("doc_id = 1").collect()
    assert len(images) == 2 and images[0].media == images[1].media
    assert media.media_features(media.to_media(docs.limit(0))).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "x"), (1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert chat.format_segments(rows).count() == 6 and chat.format_segments(rows.limit(0)).count() == 0
    assert chat.read_back(chat.format_segments(rows.limit(0))).count() == 0
