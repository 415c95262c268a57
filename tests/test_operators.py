"""Small cases of the reusable operators and column functions."""

import math
import random
import re

from pyspark.sql import functions as F

from brindle.functions.text import authorization, days_between, html_text, pay_range, tokens, years_demands
from brindle.functions.vectors import cosine
from brindle.operators import dedup, metrics
from brindle.operators.dedup import components
from brindle.operators.ranking import fuse, fuse_neutral, largest_remainder
from brindle.sources.boards import greenhouse, json_ld_postings, lever
from brindle.streaming.events import spaced


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, tokens(F.lit("Go. Node.js 150,000 .NET"))) == ["go", "node.js", "150000", ".net"]
    assert one(spark, tokens(F.lit(None).cast("string"))) == []


def test_html_text(spark):
    assert one(spark, html_text(F.lit("<p>a &amp; b</p><script>x</script><div>c<br>d</div>"))) == "a & b\nc\nd"


def test_readers(spark):
    pay = one(spark, pay_range(F.lit("pays $120k - 150k a year")))
    assert (pay.low, pay.high, pay.currency, pay.period) == (120000, 150000, "USD", "year")
    assert one(spark, authorization(F.lit("We do not offer sponsorship"))) == "UNAVAILABLE"
    assert [(r.years, r.kind) for r in one(spark, years_demands(F.lit("Must have 5+ years of Go. 2 years preferred")))] == [(5, "mandatory"), (2, "preferred")]
    assert one(spark, days_between(F.lit("2024-01-01 23:00:00").cast("timestamp"), F.lit("2024-01-02 01:00:00").cast("timestamp"))) == 0


def test_cosine(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, cosine(a(1, 0), a(1, 0))) == 1.0
    assert one(spark, cosine(a(1, 0), a(-1, 0))) == 0.0
    assert one(spark, cosine(a(1), a(1, 0))) == 0.0
    assert one(spark, cosine(a(0, 0), a(1, 0))) == 0.0


def test_ranking_metrics(spark):
    def row(pairs, k):
        df = spark.createDataFrame([("q", i, s, r) for i, (s, r) in enumerate(pairs)], "query string, key int, score double, relevance int")
        return metrics.ranking_metrics(df, k).first()

    assert row([(0.9, 1), (0.8, 1), (0.7, 0)], 10).p_at_k == 0.2
    assert row([(0.9, 1), (0.8, 1), (0.7, 0)], 2).p_at_k == 1.0
    assert abs(row([(0.9, 1), (0.8, 0), (0.7, 1)], 10).ap - 5 / 6) < 1e-12
    assert row([(0.9, 0), (0.8, 1)], 10).rr == 0.5
    assert row([(0.9, 0), (0.8, 0)], 10).rr == 0.0


def test_fusion(spark):
    r = lambda keys: spark.createDataFrame([("q", k, i + 1) for i, k in enumerate(keys)], "q string, key string, rank int")
    got = {x.key: x.score for x in fuse([r("xy"), r("yz")], ["q"], "key").collect()}
    assert abs(got["y"] - (1 / 62 + 1 / 61)) < 1e-12 and abs(got["x"] - 1 / 61) < 1e-12 and abs(got["z"] - 1 / 62) < 1e-12
    got = {x.key: x.score for x in fuse_neutral(r("abc"), r("c"), ["q"], "key").collect()}
    assert abs(got["a"] - (1 / 61 + 1 / 62)) < 1e-12 and abs(got["c"] - (1 / 63 + 1 / 61)) < 1e-12


def test_largest_remainder(spark):
    s = spark.createDataFrame([("a", 5.0), ("b", 4.0), ("c", 1.0)], "stream string, weight double")
    for total, want in ((1, [1, 0, 0]), (10, [5, 4, 1])):
        assert [x.quota for x in largest_remainder(s, total).orderBy("stream").collect()] == want


def test_jaccard_links_are_all_found_and_pairs_are_not_shuffled(spark, monkeypatch):
    draw = random.Random(7)
    sets = {}
    for n in (3, 9, 10, 11, 19, 20, 21, 40, 100, 150):
        for base in [[f"w{draw.randrange(400)}" for _ in range(n)] for _ in range(2)]:
            for _ in range(10):
                words = set(base)
                for _ in range(draw.randrange(0, max(2, n // 6))):
                    words = words - {draw.choice(base)} | {f"v{draw.randrange(50)}"}
                sets.setdefault(frozenset(words), len(sets))
    rows = spark.createDataFrame([(k, sorted(s)) for s, k in sets.items()], "k long, w array<string>")
    like = lambda a, b: len(a & b) / len(a | b)
    want = {least: {(sets[a], sets[b]) for a in sets for b in sets if sets[a] < sets[b] and like(a, b) >= least} for least in (0.9, 0.6)}
    for block in (2048, 3):
        monkeypatch.setattr(dedup, "BLOCK", block)
        for least, pairs in want.items():
            links = dedup.jaccard_links(rows, "k", "w", least)
            got = [(r.a, r.b) for r in links.collect()]
            assert set(got) == pairs and len(got) == len(pairs) > 20
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5)], "a long, b long")
    assert {r.node: r.root for r in components(e).where("node <> root").collect()} == {2: 1, 3: 1, 9: 8}


def test_donors_hold_all_texts_and_only_names_of_holders_travel(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(p, t, draw.randrange(20)) for p in range(150) for t in draw.sample(range(14), draw.choice((1, 1, 2, 2, 3, 4, 6, 9)))]
    rows += [(p, t, draw.randrange(20)) for p in range(150, 160) for t in (3, 7, 11)] + [(0, 5, 30), (0, 5, 2), (7, None, 0), (900, None, 1)]
    texts, born = {}, {}
    for p, t, a in rows:
        if t is not None:
            texts.setdefault(p, set()).add(t)
        born[p] = min(a, born.get(p, a))
    want = {p: min(((born[q], q) for q in texts if q != p and texts[p] <= texts[q]), default=(0, None))[1] for p in texts}
    chunks = spark.createDataFrame(rows, "p long, t long, age long")
    for many, common in ((64, 100_000), (3, 5), (1, 1)):
        monkeypatch.setattr(dedup, "MANY_TEXTS", many)
        monkeypatch.setattr(dedup, "MOST_BROADCAST", common, raising=False)
        got = dedup.donors(chunks, "p", "t", "age")
        found = got.collect()
        assert {r.parent: r.donor for r in found} == {p: q for p, q in want.items() if q is not None} and len({r.parent for r in found}) == len(found)
    # a holder's texts end where its pairs are listed
    lists = re.findall(r"Generate explode\(slice\(.*", got._jdf.queryExecution().optimizedPlan().toString())
    assert lists and all(re.search(r"\), \[\d", x) for x in lists)


def test_spacing_streams_a_key(spark):
    rows = [(u, i, (i * 37 * (2 + (u or 0))) % 1000) for u in (1, 2, None) for i in range(50)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, s long").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
    got = spaced(events, 30.0)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    want, last = {}, {}
    for u, i, s in sorted(rows, key=lambda r: (r[2], r[1])):
        want[u, i] = u not in last or s - last[u] >= 30
        last[u] = s if want[u, i] else last[u]
    assert {(r.user_id, r.event_id): r.allowed for r in got.collect()} == want


def test_boards(spark):
    body = '{"jobs": [{"id": 7, "absolute_url": "u", "title": " T ", "location": {"name": "Oslo"}, "content": "&lt;p&gt;Hi&lt;/p&gt;", "updated_at": "2024-01-02T03:04:05Z"}]}'
    got = greenhouse(spark.createDataFrame([("c", body), ("c", "broken")], "company string, body string")).collect()
    assert [(r.external_id, r.title, r.location, r.body) for r in got] == [("7", "T", "Oslo", "Hi")]
    body = '[{"id": "x", "hostedUrl": "h", "text": "Dev", "categories": {"location": "A", "allLocations": ["A", "B"]}, "descriptionPlain": "d", "createdAt": 1700000000000}]'
    got = lever(spark.createDataFrame([("c", body)], "company string, body string")).collect()
    assert [(r.external_id, r.locations) for r in got] == [("x", ["A", "B"])]


def test_json_ld(spark):
    html = '<script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "A"}]}</script><script type="application/ld+json">{bad</script>'
    got = json_ld_postings(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert [r.t for r in got.select(F.try_variant_get("posting", "$.title", "string").alias("t")).collect()] == ["A"]


def test_places_titles_and_contacts(spark):
    from pyspark.sql import functions as F

    from brindle.functions import places, readers

    where = {"San José, CA": "bay_area", "Toronto, ON, CA": "elsewhere", "Newark, NJ": "united_states", "Remote": "unknown", "Minsk": "unplaced", "Remote - US or Canada": "united_states", "Fresno, CA": "california", "": "unknown"}
    df = spark.createDataFrame(list(where.items()), "location string, want string")
    assert df.where(places.locality(F.col("location")) != F.col("want")).count() == 0
    said = spark.createDataFrame([("a@b.org then xa@b.org, +49 30 1234567 and a@b.org",), (None,)], "t string")
    out, contacts = readers.masked(F.col("t"))
    rows = said.select(out.alias("o"), contacts.alias("c")).select("o", readers.unmasked(F.col("o"), F.col("c")).alias("back")).collect()
    assert rows[0].back == "a@b.org then xa@b.org, +49 30 1234567 and a@b.org" and "@" not in rows[0].o and "<PHONE_0>" in rows[0].o
    assert rows[1].back == ""
    titles = spark.createDataFrame([("Senior Software Engineer II (Remote) - Platform", "software"), ("Sr. ML Engineer", "machine_learning"), ("Nurse", None)], "t string, want string")
    assert titles.where(~readers.role_of(F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def test_donors_of_parents_with_many_texts(spark, monkeypatch):
    import random

    from brindle.operators import dedup

    monkeypatch.setattr(dedup, "MANY_TEXTS", 4)
    rng = random.Random(1)
    sets = {p: {rng.randrange(9) for _ in range(rng.choice([1, 2, 3, 7]))} for p in range(60)}
    df = spark.createDataFrame([(p, t, p % 11) for p, s in sets.items() for t in s for _ in range(2)], "p long, t long, age long")
    want = {}
    for p, s in sets.items():
        fit = [(q % 11, q) for q, o in sets.items() if q != p and s <= o]
        if fit:
            want[p] = min(fit)[1]
    assert {r.parent: r.donor for r in dedup.donors(df, "p", "t", "age").collect()} == want


def test_topic_entropies_are_entropies(spark, sf):
    import math

    from brindle.plans import registry

    got = registry.queries()["topic_entropy"](spark, sf).collect()
    assert got and all(0 <= r.entropy <= math.log(8) + 1e-6 for r in got)


def test_kendall_counts_inversions_in_chunks(spark):
    """Ties on both sides, groups of one value, a group with most rows, and chunks far below a group, against all pairs."""
    rng = random.Random(3)
    rows = [(g, rng.randrange(n), rng.choice([None, *range(m)])) for g, size, n, m in (("a", 300, 9, 40), ("b", 40, 40, 5), ("c", 10, 1, 3), ("d", 5, 9, 1), ("e", 1, 2, 2)) for _ in range(size)]
    df = spark.createDataFrame(rows, "g string, x int, y int")
    want = {}
    for g in "abcde":
        p = [(x, y) for k, x, y in rows if k == g and y is not None]
        sign = lambda d: (d > 0) - (d < 0)
        pairs = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(p) for b in p[:i]]
        size = math.sqrt(sum(x != 0 for x, _ in pairs) * sum(y != 0 for _, y in pairs))
        if p:
            want[g] = sum(x * y for x, y in pairs) / size if size else None
    for chunk in (10, 60, 10_000):
        got = {r.g: r.kendall_tau for r in metrics.kendall_tau(df, ["g"], "x", "y", chunk=chunk).collect()}
        assert got.keys() == want.keys()
        assert all(got[g] == want[g] or math.isclose(got[g], want[g], abs_tol=1e-12) for g in want)
