"""Readers, résumés, linkage and differences on small and odd cases."""

import html
import random
import re

import numpy as np
from pyspark.sql import functions as F

from brindle.functions import papers
from brindle.functions.vectors import half
from brindle.operators import diff, linkage
from brindle.sources import boards, files, mail


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_boards_with_odd_pages(spark):
    odd = [("a", None), ("a", ""), ("a", "{"), ("a", "[]"), ("a", "{}"), ("a", '{"jobs": null}')]
    pages = spark.createDataFrame(odd, "company string, body string")
    for read in (boards.greenhouse, boards.lever, boards.ashby, boards.workable, boards.breezy, boards.workday, boards.oracle, boards.icims, boards.remotive, boards.arbeitnow, boards.remoteok, boards.rippling):
        got = read(pages)
        assert tuple(got.columns) == boards.COLUMNS and got.count() == 0, read.__name__


def test_rippling_merges_a_job_and_tells_rows(spark):
    import json

    def page(total, items):
        data = {"props": {"pageProps": {"dehydratedState": {"queries": [{"queryKey": ["other"]}, {"queryKey": ["board", "x", "job-posts"], "state": {"data": {"totalItems": total, "items": items}}}]}}}}
        return f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script>'

    here = lambda n, kind="ON_SITE": [{"name": n, "workplaceType": kind}]
    rows = [("a", page(4, [{"id": "1", "name": "Dev", "locations": here("Oslo")}, {"id": "1", "name": "Dev", "locations": here("Rome", "REMOTE")}])), ("a", page(4, [{"id": "2", "name": "Ops", "locations": None}, {"id": None, "name": "x"}]))]
    pages = spark.createDataFrame(rows, "company string, body string")
    got = {r.external_id: r for r in boards.rippling(pages).collect()}
    assert got["1"].locations == ["Oslo", "Remote (Rome)"] and got["2"].location is None and len(got) == 2
    told = boards.rippling_announced(pages).first()
    assert (told.announced, told.read) == (4, 4)


def test_mail_forms(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"Message-ID: <1@x>\r\nSubject: =?utf-8?q?caf=C3=A9?=\r\nFrom: A <a@x>\r\nContent-Transfer-Encoding: quoted-printable\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nna=C3=AFve=\r\n line\r\n")
    (tmp_path / "b.mbox").write_text("From x@y Mon\nSubject: one\nDate: nonsense\n\n>From here\n\nFrom x@y Tue\nMessage-ID: <3@x>\n\ntwo\n")
    got = {r.message_id: r for r in mail.messages(spark, str(tmp_path)).collect()}
    assert len(got) == 3
    assert (got["<1@x>"].subject, got["<1@x>"].body) == ("café", "naïve line")
    assert got["<3@x>"].body == "two"
    (other,) = [r for k, r in got.items() if not k.startswith("<")]
    assert (other.body, other.subject, other.sent_at) == ("From here", "one", None)


def test_csv_keeps_white_space(spark, tmp_path):
    files.write_csv(spark.createDataFrame([(' a "b", \n', [1, 2])], "t string, v array<int>"), str(tmp_path / "c"))
    got = spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True, escape='"').first()
    assert (got.t, got.v) == (' a "b", \n', "[1,2]")


def test_dates_of_papers(spark):
    only = lambda x: one(spark, papers.date_only(F.lit(x)))
    behind = lambda x: one(spark, papers.trailing_date(F.lit(x)))
    assert only("Mar 2021 - Present") == "Mar 2021 - Present" and behind("Mar 2021 - Present") is None
    assert only("2015") == "2015" and behind("Analyst 2015") is None
    assert behind("Staff Engineer, Acme Mar 2021 - Present") == "Mar 2021 - Present"
    assert behind("Intern, Summer 2023") == "Summer 2023" and only("") is None
    assert one(spark, papers.open_ended(F.lit("Engineer May 2024 -"))) and not one(spark, papers.open_ended(F.lit("May 2024 - June 2025")))


def test_defects(spark):
    good = "A\na@b.co +1 555 0100 200 https://x\nExperience\nDev Mar 2021 - Present\nEducation\nBSc 06/2012\nSkills\nPython"
    rows = [(1, good, "k"), (2, None, "k"), (3, "Experience\n" + "\n".join(["x" * 301] * 3), "k")]
    got = {r.id: r for r in papers.defects(spark.createDataFrame(rows, "id int, text string, line string"), "id", "text").collect()}
    assert got[1].parse == 1.0
    # an empty paper lacks everything: 0.30 + 0.08 + 0.04 + 0.25 + 0.10 + 0.10 + 0.15 is more than all there is
    assert got[2].parse == 0.0 and got[2].no_dates == 1
    assert got[3].overlong_bullet == 3 and abs(got[3].parse - round(1 - (0.30 + 0.08 + 0.04 + 0.10 + 0.10 + 0.15 + 0.02 * 1.75), 3)) < 1e-9


def test_packages(spark):
    got = lambda p, t: one(spark, papers.packages_in(F.lit(p), F.lit(t)))
    assert got("r/requirements.txt", "A_b.c>=1\n# no\n-e .\nx[y]~=2 # why\n\nfoo @ https://x\n") == ["a-b-c", "foo", "x"]
    assert got("package.json", '{"dependencies": {"B": "1"}}') == ["b"] and got("package.json", "{") == []
    assert got("Cargo.toml", '[dependencies]\nserde = "1"\n[workspace.dependencies]\ntokio_x = {a = 1}\n[features]\nq = []\n') == ["serde", "tokio-x"]
    assert got("readme.md", "x") == [] and got("package.json", None) == []


def test_mail_headers_parts_and_dates(spark, tmp_path):
    nested = (
        "Message-ID: <n@x>\nSubject: =?ISO-8859-1?Q?Caf=E9_=3D?= =?utf-8?B?w6k=?= plain\n folded\nFrom: a@x\nDate: Tue, 3 Feb 2026 09:05 EST (note)\n"
        'Content-Type: multipart/mixed; boundary="out"\n\npreamble\n--out\nContent-Type: multipart/alternative;\n boundary=out2\n\n--out2\nContent-Type: text/html\n\n<p>no</p>\n'
        "--out2\nContent-Type: text/plain; charset=latin1\nContent-Transfer-Encoding: quoted-printable\n\nna=EFve =3D ye=\ns\n--out2--\n--out\nContent-Type: text/plain\nContent-Disposition: attachment\n\nattached\n--out--\nend\n"
    )
    for name, text in (("n.eml", nested), ("h.eml", "Message-ID: <h@x>\nContent-Type: text/html\nDate: 3 Feb 2026 09:05:07 +0530\n\n<b>x</b>\n"), ("e.eml", "Message-ID: <e@x>\nSubject: =?utf-8?b?!!?=\nContent-Transfer-Encoding: base64\n\n*not base 64*\n"), ("b.eml", "Message-ID: <b@x>\nContent-Type: application/pdf\n\n%PDF")):
        (tmp_path / name).write_text(text)
    got = {r.message_id: r for r in mail.messages(spark, str(tmp_path)).select("*", F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss").alias("at")).collect()}
    assert (got["<n@x>"].subject, got["<n@x>"].body, got["<n@x>"].at) == ("Café =é plain folded", "naïve = yes", "2026-02-03 14:05:00")
    assert (got["<h@x>"].body, got["<h@x>"].at, got["<h@x>"].subject) == ("<b>x</b>", "2026-02-03 03:35:07", None)
    assert got["<b@x>"].body == "" and got["<e@x>"].sender is None and len(got) == 4


def test_half_is_half(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, s, 500) for s in (1e-8, 1e-5, 1e-2, 1, 300)] + [[0.0, 1.0, -1.0, 2.0**-14, 2.0**-24, 2.0**-25, 65504.0, 65519.0, 65520.0, -70000.0]])
    got = [r.y for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", half(F.col("x")).alias("y")).orderBy("i").collect()]
    with np.errstate(over="ignore"):
        assert got == x.astype(np.float16).astype(float).tolist()


def test_differences_rebuild_both_sides(spark):
    rng = np.random.default_rng(6)
    words = ["a", "b", "c", "d<e", "f&g"]
    text = lambda: " ".join(rng.choice(words, rng.integers(0, 12)))
    rows = [(text(), text()) for _ in range(200)] + [(None, "a"), ("a", None), (None, None), ("a b", "a b")]
    d = spark.createDataFrame(rows, "old string, new string").select("old", "new", diff.word_edits(F.col("old"), F.col("new")).alias("e"))
    for r in d.select("*", diff.side(F.col("e"), diff.GONE).alias("was"), diff.side(F.col("e"), diff.CAME).alias("now"), diff.marked(F.col("e")).alias("m")).collect():
        assert (r.was, r.now) == (r.old or "", r.new or "")
        plain = re.sub("<del>[^<]*</del>", "", r.m).replace("<ins>", "").replace("</ins>", "").split()
        assert [html.unescape(x) for x in plain] == (r.new or "").split()
    assert one(spark, diff.line_diff(F.lit("a\nb"), F.lit("a\nb"))) == ""
    assert one(spark, diff.line_diff(F.lit("a\nb"), F.lit("a\nc"))).split("\n")[-2:] == ["-b", "+c"]
    assert one(spark, diff.line_diff(F.lit("a\nb\nc\nd\ne\nf"), F.lit("x\nb\nc\nd\ne\ng\nf"))) == "@@ -1,2 +1,2 @@\n-a\n+x\n b\n@@ -5,2 +5,3 @@\n e\n+g\n f"


def test_alignment_keeps_the_longest_run_of_words_that_stand_once():
    rng = random.Random(8)
    for _ in range(400):
        a = rng.sample(range(12), rng.randrange(13))
        b = rng.sample(range(14), rng.randrange(15))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = diff.aligned([str(x) for x in a], [str(y) for y in b])
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_long_texts_are_aligned():
    """A megabyte of words on each side, one in a thousand changed, and one of words that all repeat."""
    rng = random.Random(1)
    a = [f"w{rng.randrange(60_000)}" for _ in range(200_000)]
    b = [w if rng.random() > 0.001 else "new" for w in a]
    assert len(diff.aligned(a, b)) >= 0.99 * sum(x == y for x, y in zip(a, b))
    few = [rng.choice("ab") for _ in range(200_000)]
    assert len(diff.aligned(few, few[:100_000] + ["c"] + few[100_000:])) == 200_000


def test_named_companies(spark):
    co = spark.createDataFrame([(1, "Weights & Measures (Corewood)"), (2, "Do"), (3, "Acme Inc"), (4, None), (5, "")], "id int, name string")
    q = spark.createDataFrame([("a", "jobs at corewood"), ("b", "Weights & Measures?"), ("c", "what to do"), ("d", "ACME, please"), ("e", None), ("f", "acmes")], "k string, text string")
    common = spark.createDataFrame([("do",)], "term string")
    got = sorted((r.k, r.id) for r in linkage.named_in(q, "k", "text", co, "id", "name", common).collect())
    assert got == [("a", 1), ("b", 1), ("d", 3)]


def test_confirmed(spark):
    rows = [
        ("acme", "slug", "Acme", "acme.com", None),
        ("acme", "slug", "Acme", "acme.im", ""),
        ("acme", "name", "Acme", "getacme.io", ""),
        ("acme", "name", "Acme", "acmepower.com", "see x.acmepower.com."),
        ("acme", "name", "Acme", "acmepower.com", "see notacmepower.com"),
        ("acme", "name", "Acme", None, ""),
    ]
    got = [r.reason for r in linkage.confirmed(spark.createDataFrame(rows, "slug string, why string, company string, domain string, text string").coalesce(1)).collect()]
    assert got == ["owns the .com of its slug", None, "site and name agree", "board points at the site", None, "no site known"]
