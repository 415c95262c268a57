"""Held-out weights, places in a hierarchy, claims and paged boards on small and odd cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import claims, hierarchy, personal
from brindle.session import shared_dir
from brindle.sources import paged


def test_weights_of_a_fold_come_from_the_others(spark):
    rng = random.Random(7)
    graded = [(k, rng.randrange(4), float(rng.random()), rng.randrange(2)) for k in range(200)] + [(200, 4, 0.5, 1)]
    traits = [(k, t) for k, *_ in graded for t in rng.sample("abcde", rng.randrange(4))] + [(200, "only here")]
    g, t = spark.createDataFrame(graded, "key long, fold int, score double, grade int"), spark.createDataFrame(traits, "key long, trait string")
    got = {(r.fold, r.trait): r.weight for r in personal.fold_weights(g, t, 5).collect()}
    want = {}
    for f in range(5):
        rest = {k: grade for k, fold, _, grade in graded if fold != f}
        for trait in {x for _, x in traits}:
            own = [rest[k] for k, x in traits if x == trait and k in rest]
            if len(own) >= 3:
                want[f, trait] = max(-0.3, min(0.3, sum(own) / len(own) - sum(rest.values()) / len(rest)))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    out = {r.fold: r for r in personal.held_out_ranking(g, t, 5).collect()}
    assert out[4].status == "insufficient" and out[0].status in ("better", "no better") and sum(r.n for r in out.values()) == 201


def test_preferences_that_tell_are_found(spark):
    """Grades that follow a trait and not the score: the held-out order gets better."""
    rows = [(k, k % 3, (k * 37 % 100) / 200, int(k * 7919 % 11 < 4)) for k in range(600)]
    traits = [(k, "good" if grade else "bad") for k, _, _, grade in rows]
    out = personal.held_out_ranking(spark.createDataFrame(rows, "key long, fold int, score double, grade int"), spark.createDataFrame(traits, "key long, trait string"), 3).collect()
    assert [r.status for r in out] == ["better"] * 3 and all(r.personal_ndcg > r.base_ndcg + 0.1 for r in out)


NODES = [("world", None), ("eu", "world"), ("us", "world"), ("de", "eu"), ("fr", "eu"), ("berlin", "de"), ("ca", "us"), ("sf", "ca"), ("la", "ca"), ("round", "trip"), ("trip", "round")]
NAMES = [("de", "Germany"), ("fr", "France"), ("eu", "Europe"), ("berlin", "Berlin"), ("us", "United States"), ("us", "USA"), ("ca", "California"), ("sf", "San Francisco"), ("sf", "SF"), ("la", "Los Angeles"), ("round", "Nowhere")]


def test_places_resolve_to_what_holds_them(spark):
    texts = [
        ("Berlin, Germany", 1, "berlin"), ("Germany; Berlin", 2, "de"), ("Berlin or France", 2, "eu"), ("San Francisco, California, USA", 1, "sf"), ("SF / Los Angeles", 2, "ca"),
        ("Los Angeles, SF", 1, "ca"), ("Europe", 1, "eu"), ("Berlin and SF", 2, "world"), ("Remote", 0, None), ("", 0, None), (None, 0, None), ("Nowhere", 0, None), ("Germanys", 0, None), ("berlin BERLIN", 1, "berlin"),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(texts)], "id long, place string")
    nodes, names = spark.createDataFrame(NODES, "node string, parent string"), spark.createDataFrame(NAMES, "node string, spelling string")
    got = {r.doc: (r.offices, r.node) for r in hierarchy.resolved(df, "id", "place", names, nodes).collect()}
    assert got == {k: (n, node) for k, (_, n, node) in enumerate(texts)}
    paths = {r.node: r.path for r in hierarchy.with_paths(nodes).collect()}
    assert paths["sf"] == ["world", "us", "ca", "sf"] and "round" not in paths
    assert hierarchy.resolved(df.limit(0), "id", "place", names, nodes).count() == 0


def test_claims_are_borne_out_by_one_sentence(spark):
    sources = [
        (1, "In 2019 the Postgres cluster served 1,200 requests. Kafka moved events. It was built by Ann."),
        (2, "Kubernetes ran in Berlin. The cluster was enlarged by 40%."),
        (3, None),
        (4, ""),
    ]
    asked = [
        (1, "We served 1200 requests with postgres in 2019", 1, 1),  # a comma and a capital aside
        (2, "We served 1300 requests with Postgres in 2019", 0, None),  # a figure made up
        (3, "There Kafka served 1,200 requests", 0, None),  # true apart, not of one sentence
        (4, "We ran K8s in Berlin", 1, 2),  # by its other name
        (5, "The cluster grew by 40%", 1, 2),
        (6, "it is so", 0, None),
        (7, None, 0, None),
    ]
    alias = claims.closed(spark.createDataFrame([("k8s", "kube"), ("Kube", "Kubernetes"), ("x", "x")], "a string, b string"))
    got = {r.claim: r for r in claims.supported(spark.createDataFrame([a[:2] for a in asked], "id long, text string"), "id", spark.createDataFrame(sources, "doc long, text string"), "doc", aliases=alias).collect()}
    assert {k: (r.support, r["first"]) for k, r in got.items()} == {k: (n, d) for k, _, n, d in asked}
    assert got[6].n == 0 and got[2].kinds == ["figure", "name", "term", "year"]


def test_planted_claims_of_the_table_are_found(spark, sf):
    """Recall of made-up claims, and of true ones, over the documents."""
    from brindle.plans.registry import queries

    rows = queries()["claim_support"](spark, sf.replace("0.001", "0.01")).where("n > 0").collect()
    false, true = [r for r in rows if r.planted], [r for r in rows if not r.planted]
    assert len(false) > 10 and sum(r.support == 0 for r in false) / len(false) > 0.95
    assert all(r.support > 0 for r in true)


def test_paged_boards(spark):
    page = lambda c, n, total, jobs: (c, n, json.dumps({"total": total, "jobs": [f"{c}{n}{k}" for k in range(jobs)]}))
    rows = [page("whole", 0, 5, 2), page("whole", 1, 5, 2), page("whole", 2, 5, 1), page("a/b = c", 0, 2, 2), page("hole", 0, 9, 2), page("hole", 3, 9, 2), page("late", 1, 4, 2), page("none", 0, 0, 0)]
    folder = paged.pages_written(spark.createDataFrame(rows, "company string, page int, body string"), "test-pages")
    assert folder.startswith(shared_dir(spark))
    got = paged.read_pages(spark, folder, 2)
    assert got.rdd.getNumPartitions() == len(rows)
    assert sorted((r.company, -1 if r.page is None else r.page, r.announced, r.missing) for r in got.collect()) == [
        ("a/b = c", 0, 2, 0), ("hole", -1, 9, 3), ("late", -1, 4, 1), ("none", 0, 0, 0), ("whole", 0, 5, 0), ("whole", 1, 5, 0), ("whole", 2, 5, 0),
    ]
    assert all((r.body is None) == (r.missing > 0) for r in got.collect())
    with pytest.raises(Exception, match="pages are missing"):
        paged.read_pages(spark, folder, 2, incomplete="fail").collect()
    assert paged.read_pages(spark, folder, 2).where(F.col("company") == "whole").count() == 3


def test_claims_meet_sentences_without_a_row_for_each_pair(spark, monkeypatch):
    sizes = []

    def counted(df, label="step", write=claims.written):
        out = write(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(claims, "written", counted)
    asked = [(k, f"we said Platform {k % 20 + 1}") for k in range(40)] + [(40, "we said Platform"), (41, "we said nothing")]
    sources = [(k, f"The platform at {k} is old. It is a platform; {k % 10 + 1}.") for k in range(100, 200)]
    rows = lambda: {r.claim: (r.n, r.support, r["first"]) for r in claims.supported(spark.createDataFrame(asked, "id long, text string"), "id", spark.createDataFrame(sources, "doc long, text string"), "doc").collect()}
    want = {k: (2, 10, 100 + k % 20) if k % 20 < 10 else (2, 0, None) for k in range(40)} | {40: (1, 100, 100), 41: (1, 0, None)}
    assert rows() == want and max(sizes) <= 200
    monkeypatch.setattr(claims, "MOST_BROADCAST", 0)
    assert rows() == want


def test_many_pages_are_few_tasks(spark, monkeypatch):
    rows = [(c, n, json.dumps({"total": 60})) for c in ("whole", "holes", "more") for n in range(31 if c == "more" else 30) if c != "holes" or n % 4 != 1]
    folder = paged.pages_written(spark.createDataFrame(rows, "company string, page int, body string"), "test-pages")
    monkeypatch.setattr(paged, "MOST_TASKS", 7)
    parts = paged._Reader({"path": folder, "page_size": "2"}).partitions()
    assert len(parts) == 7 and sum(len(p.pages) for p in parts) == len(rows)
    assert max(len(r) for p in parts for c, r in p.runs.items() if c != "holes") == 1  # no page carries its board's list of pages
    reader = paged._Reader({"path": folder, "page_size": "2"})
    got = [tuple(b.to_pylist()[0].values())[:2] + (b.to_pylist()[0]["missing"],) for p in parts for b in reader.read(p)]
    assert sorted(got, key=str) == sorted([("whole", n, 0) for n in range(30)] + [("more", n, 0) for n in range(31)] + [("holes", None, 8)], key=str)
