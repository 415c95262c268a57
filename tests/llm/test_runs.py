"""Periodic runs against a search of all periods."""

import hashlib
import random
import re
import zlib

import pytest

from brindle.llm import runs


def plain_runs(words, least=12):
    """All runs by trying each period at each place."""
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        t = 0
        while t < n - q:
            if words[t] != words[t + q]:
                t += 1
                continue
            a = t
            while t < n - q and words[t] == words[t + q]:
                t += 1
            b = t + q
            part = words[a:b]
            if b - a >= max(least, 2 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.add((a, b - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def drawn(rng):
    """A text of few or many different words with stretches that go in circles."""
    few = rng.choice([1, 2, 3, 5, 40, 300])
    words = [b"w%d" % rng.randrange(few) for _ in range(rng.randrange(0, 90))]
    for _ in range(rng.randrange(0, 3)):
        p = rng.choice([1, 2, 3, 5, 6, 7, 8, 13, 15, 16, 31])
        root = [b"r%d" % rng.randrange(4) for _ in range(p)]
        k = rng.randrange(0, len(words) + 1)
        words[k:k] = (root * 40)[: rng.randrange(1, 4 * p + 14)]
    return words


def test_runs_are_those_of_all_periods():
    rng = random.Random(11)
    for _ in range(1500):
        words = drawn(rng)
        got = [tuple(map(int, r)) for r in runs.runs_of(runs.numbered(words))] if words else []
        assert got == plain_runs(words), words


@pytest.mark.parametrize("least", [2, 5, 12, 40])
def test_other_least_lengths(least):
    rng = random.Random(least)
    for _ in range(200):
        words = drawn(rng)
        got = [tuple(map(int, r)) for r in runs.runs_of(runs.numbered(words), least)] if words else []
        assert got == plain_runs(words, least), words


def test_nested_and_long():
    inner = [b"a", b"b"] * 10 + [b"c"]
    words = inner * 9
    got = [tuple(map(int, r)) for r in runs.runs_of(runs.numbered(words))]
    assert got == plain_runs(words) and (0, 189, 21) in got
    many = [b"x%d" % k for k in range(5000)]
    assert [tuple(map(int, r)) for r in runs.runs_of(runs.numbered(many * 3 + many[:7]))] == [(0, 15007, 5000)]
    one = [b"x"] * 50_000
    assert runs.runs_of(runs.numbered(one)).tolist() == [[0, 50_000, 1]]
    assert runs.without_repeats(one, runs.runs_of(runs.numbered(one))) == [b"x"]


def test_every_word_of_a_large_vocabulary_is_spelled():
    words = [b"v%d" % (k % 5000) for k in range(10_000)] + [b"end"]
    assert runs.runs_of(runs.numbered(words)).tolist() == [[0, 10_000, 5000]]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    got = plain_runs(words)
    best = max(got, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    drop = {i for a, length, q in got for i in range(a + q, a + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(got), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in got)), sha(kept))


def test_query_rows(spark, sf):
    """The whole table, long texts of many words left to the tests above."""
    got = {r.doc_id: tuple(r) for r in runs.op11(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert set(got) == {d.doc_id for d in docs}
    for d in docs:
        if d.n_chars < 4000:
            assert got[d.doc_id] == expected(d.doc_id, d.text)
    assert sum(r[1] > 0 for r in got.values()) > len(docs) // 20


def test_odd_rows(spark):
    text = "a b " * 8
    rows = [(None, text, 1), (1, None, 2), (2, "", 3), (3, " \n ", 4), (4, text, 5), (4, text, 5), (5, "é 中� " * 9, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumnRenamed("runs", "a.b")
    got = runs.find_runs(docs, ("doc_id", "a.b"))
    assert got.columns == ["doc_id", "a.b", "n_words", "runs", "collapsed"]
    out = sorted(((r[1], r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()))
    assert out == [
        (1, 16, [(0, 16, 2)], "a b"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""),
        (5, 16, [(0, 16, 2)], "a b"), (5, 16, [(0, 16, 2)], "a b"), (6, 18, [(0, 18, 2)], "é 中�"),
    ]
    clash = docs.withColumnRenamed("a.b", "runs").withColumn("_raw", docs["doc_id"])
    again = runs.find_runs(clash, ("runs", "_raw"))
    assert again.columns == ["runs", "_raw", "n_words", "runs_", "collapsed"] and again.count() == 7
    assert runs.find_runs(docs.limit(0), ("doc_id",)).collect() == []
