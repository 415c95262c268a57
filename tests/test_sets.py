"""Hand-kept files in their odd forms, and what is refused."""

import json

import pytest

from brindle.sources import sets
from brindle.trace import Trace

REGISTRY = """# boards
companies:
- name: 'Owner''s, Inc'   
  slug: owners   # polled
  poll_interval_s: 21600
  checked: '2026-09-07'

- slug: two
  name: >
    Two
    lines
  ats: lever
  state: "a # b: \\"c\\"\\\\n"
- name: ~
  slug: three
  note: |
    first: x
    - second
retired: []
version: 7
"""


def test_registry(spark, tmp_path):
    (tmp_path / "r.yaml").write_text(REGISTRY)
    on, off = sets.registry(spark, str(tmp_path / "r.yaml"))
    got = {r.slug: r for r in on.collect()}
    assert set(got) == {"owners", "two", "three"} and off.count() == 0
    assert (got["owners"].name, got["owners"].poll_interval_s, got["owners"].ats, got["owners"].checked) == ("Owner's, Inc", 21600, "greenhouse", "2026-09-07")
    assert (got["two"].name, got["two"].ats, got["two"].state) == ("Two lines", "lever", 'a # b: "c"\\n')
    assert got["three"].name is None
    rows = {(r.section, r.item): r.entry for r in sets.yaml_lists(spark, str(tmp_path / "r.yaml")).collect()}
    assert rows["companies", 3]["note"] == "first: x\n- second" and rows["version", 0] == {"value": "7"} and rows["retired", 0] is None


def test_what_is_no_registry_is_refused(spark, tmp_path):
    for name, text in (("a", "boards:\n- slug: x\n"), ("b", "- slug: x\n"), ("c", "")):
        (tmp_path / f"{name}.yaml").write_text(text)
        with pytest.raises(sets.UnreadableSet):
            sets.registry(spark, str(tmp_path / f"{name}.yaml"))
    (tmp_path / "d.yaml").write_text("companies: []\n")
    on, off = sets.registry(spark, str(tmp_path / "d.yaml"))
    assert on.count() == off.count() == 0


def test_labelled_sets(spark, tmp_path):
    one = "- key: {}\n  title: t\n  description: d\n  relevance: {}\n  provenance: {}\n"
    path = tmp_path / "l.yaml"
    path.write_text("name: n\npostings:\n" + one.format("a", 2, "owner") + one.format("b", 0, "fixture"))
    assert sorted((r.key, r.relevance, r.location) for r in sets.labelled_set(spark, str(path)).collect()) == [("a", 2, "Remote"), ("b", 0, "Remote")]
    for bad in (one.format("a", 2, "owner") * 2, one.format("a", 2, "guess"), one.format("a", "x", "owner"), ""):
        path.write_text("name: n\npostings:\n" + bad)
        with pytest.raises(sets.UnreadableSet):
            sets.labelled_set(spark, str(path))


def test_question_sets(spark, tmp_path):
    path = tmp_path / "q.json"
    item = {"key": "k", "question": "?", "stratum": "s", "expect": "answer"}
    path.write_text(json.dumps({"version": "1", "depth": 5, "modes": {"m": {"x": "y"}}, "questions": [item, item | {"key": "k2", "expect": "none"}]}, indent=1))
    assert sorted(r.key for r in sets.question_set(spark, str(path)).collect()) == ["k", "k2"]
    for bad in ([item, item], [item | {"expect": "maybe"}], [item | {"key": ""}], [item | {"key": "x" * 65}], []):
        path.write_text(json.dumps({"version": "1", "depth": 5, "modes": {}, "questions": bad}))
        with pytest.raises(sets.UnreadableSet):
            sets.question_set(spark, str(path))


def test_directories(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ats_vendor,board_slug,company_name\nLever, acme ,"Acme, Inc"\nlever,,No slug\nlever,acme,"Acme, Inc"\n')
    (tmp_path / "b.csv").write_text("company,platform,token,seen\nBolt,ASHBY,bolt,1\n")
    (tmp_path / "c.csv").write_text("name,slug\nx,y\n")
    got = sets.board_directories(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted(map(tuple, got.collect())) == [("ashby", "bolt", "Bolt"), ("lever", "acme", "Acme, Inc")]
    with pytest.raises(sets.UnreadableSet):
        sets.board_directories(spark, [str(tmp_path / "c.csv")])


def test_trace_keeps_stages_that_fail(spark):
    t = Trace()
    assert t.stage("one", lambda: spark.range(3)).count() == 3
    with pytest.raises(ZeroDivisionError):
        t.stage("two", lambda: 1 / 0)
    assert [(r.stage, r["items"], r.success) for r in t.table(spark).orderBy("place").collect()] == [("one", 3, True), ("two", 0, False)]
