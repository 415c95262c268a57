"""Counts of the quality rules against plain readings, and the cutoffs' guarantee."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from brindle.llm import rules
from brindle.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def plain_values(text):
    w = WORD.findall(text)
    n, chars, sym, dup, rep = plain_counts(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    length = min(chars / max(n, 1) / 20, 1.0)
    lettered = sum(bool(re.search(r"[A-Za-z\u0080-\U0010ffff]", x)) for x in w)
    ended = sum(WORD.findall(x)[-1][-1] in ".!?" for x in lines)
    n, chars, k = max(n, 1), max(chars, 1), max(len(lines), 1)
    return [length, 1 - length, sym / chars, dup / k, rep / n, 1 - lettered / n, len(re.findall("[A-Z]", text)) / chars, (len(lines) - ended) / k, 1 - len(set(w)) / n]


def test_counts_of_made_up_texts():
    rng = random.Random(5)
    alphabet = ["a", "b", "c", "é", "#", "|", " ", " ", "\n", "\t", "\x85", " ", ".", "A", "x y z p q "]
    for _ in range(800):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert rules.counts_of(text.encode())[:5] == plain_counts(text), repr(text)


def test_binomial_tail():
    for n, p in ((1, 0.3), (12, 0.05), (200, 0.02), (1000, 0.1)):
        total = 0.0
        for k in range(n + 1):
            total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            assert rules.binomial_tail(k, n, p) == 1.0 if k >= n * p else abs(rules.binomial_tail(k, n, p) - total) < 1e-9


def plain_selection(rows, hash_side, levels=rules.LEVELS, price=rules.PRICE, risk=rules.RISK, error=rules.ERROR):
    """rows: stratum, text, label -> stratum -> cutoffs by trying each."""
    step = lambda v: math.floor(v * rules.STEPS + 1e-9)
    texts = {}
    for s, t, y in rows:
        texts[s, t] = min(y, texts.get((s, t), 1))
    sides = {True: {}, False: {}}
    for (s, t), y in texts.items():
        sides[hash_side[t]].setdefault(s, []).append(([step(v) for v in plain_values(t)], y))
    out = {}
    for s, tune in sides[True].items():
        path = []
        for level in levels:
            cuts = []
            for r in range(9):
                good, bad = [v[r] for v, y in tune if y], [v[r] for v, y in tune if not y]
                best = None
                for c in {v[r] for v, _ in tune} - {0}:
                    g, b = sum(x >= c for x in good) / max(1, len(good)), sum(x >= c for x in bad) / max(1, len(bad))
                    if g <= level and b - price * g > 0:
                        best = max(best or (-1, 0), (b - price * g, c))
                cuts.append(best and best[1])
            path.append(cuts)
        good = [v for v, y in sides[False].get(s, []) if y]
        for cuts in path:
            lost = sum(any(c is not None and x >= c for x, c in zip(v, cuts)) for v in good)
            if not good or rules.binomial_tail(lost, len(good), risk) > error / len(sides[True]):
                break
            out[s] = cuts
    return out


def test_whole_result_is_that_of_trying_all_cutoffs(spark, sf):
    """Documents of sf0.01, so that some strata can be certified and others cannot."""
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    how = {"risk": 0.1, "error": 0.2}
    got = {r.doc_id: r for r in rules.quality_rules(docs, labels, **how).collect()}
    side = {r.text: r.side for r in docs.selectExpr("text", "pmod(xxhash64('half', xxhash64(text)), 2) = 0 side").collect()}
    rows = docs.collect()
    quality = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    failed = lambda c: c[0] < 10 or 100 * c[4] > 20 * c[0]
    counts = {r.doc_id: plain_counts(r.text) for r in rows}
    known = [("s" + r.lang if r.lang else "n", r.text, quality[r.doc_id]) for r in rows if r.doc_id in quality and not failed(counts[r.doc_id])]
    cuts = plain_selection(known, side, **how)
    assert cuts and len(got) == len(rows)
    rejected = 0
    for r in rows:
        c = cuts.get("s" + r.lang if r.lang else "n")
        bad = c is not None and any(x is not None and math.floor(v * rules.STEPS + 1e-9) >= x for v, x in zip(plain_values(r.text or ""), c))
        g = got[r.doc_id]
        assert tuple(g[k] for k in rules.COUNTS) == counts[r.doc_id]
        assert g.base_failed == failed(counts[r.doc_id]) and g.kept == (not g.base_failed and not bad)
        rejected += bad
    assert rejected > 10


def test_guarantee_holds_where_nothing_tells_good_from_bad(spark):
    """Labels by chance: cutoffs that reject more than the risk of good texts are refused."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["one", "two%", "Three", "FOUR", "5"]) for _ in range(60)), "x") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, rng.randrange(2)) for k, _, _ in rows], "doc_id long, quality int")
    out = rules.quality_rules(docs, labels).join(labels, "doc_id").where("quality = 1 AND NOT base_failed")
    n, lost = out.count(), out.where("NOT kept").count()
    assert n > 500 and lost <= rules.RISK * n


def test_odd_rows(spark):
    text = "Ten words stand in this text so that it passes."
    rows = [(None, text, None, 1), (1, None, "en", 2), (2, "", "en", 3), (3, text, "en", 4), (3, text, "en", 4), (4, "w " * 3000, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int").withColumn("a.b", F.lit(1))
    none = spark.createDataFrame([(3, None)], "doc_id long, quality int")
    for labels in (none, none.limit(0)):
        out = rules.quality_rules(docs, labels)
        assert sorted(((r.doc_id or 0, r.n_words, r.n_repeat_words, r.kept) for r in out.collect())) == [(0, 10, 0, True), (1, 0, 0, False), (2, 0, 0, False), (3, 10, 0, True), (3, 10, 0, True), (4, 3000, 3000, False)]
        assert rules.quality_rules(docs.limit(0), labels).count() == 0
    assert rules.measure(docs, ("a.b", "kept")).columns[:3] == ["a.b", "kept", "text_hash"]
