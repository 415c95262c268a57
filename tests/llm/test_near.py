"""Near copies and SimHash links against brute force."""

import random

import numpy as np
import pytest

from brindle.llm import near, simhash


def shingles(t, width=5):
    w = (t or "").lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and find(a) != find(b) and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def texts():
    rng = random.Random(8)
    word = lambda: "w" + str(rng.randrange(3000))
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 8, 60])):
            t = list(base)
            for _ in range(rng.randrange(1 + len(t) // 60)):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
    return out + [None, "", "  ", "one", "ONE", out[0], out[0].upper()]


def test_near_copies_agree_with_brute_force(spark):
    t = texts()
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    sets = [shingles(x) for x in t]
    j = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = components(range(len(t)), j)
    assert {r.doc_id: r.component_id for r in near.near_copies(df).collect()} == want
    kept = {r.doc_id for r in near.one_of_each(df).collect()}
    assert kept == set(want.values())


@pytest.mark.parametrize("few", [3, 1000])
def test_long_lists_lose_no_link(spark, monkeypatch, few):
    monkeypatch.setattr(near, "SHORT_LIST", 3)
    monkeypatch.setattr(near, "FEW", few)
    monkeypatch.setattr(near, "BLOCK", 4)
    t = texts()
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    sets = [shingles(x) for x in t]
    want = components(range(len(t)), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert {r.doc_id: r.component_id for r in near.near_copies(df).collect()} == want


def test_chains_in_one_long_list_lose_no_link(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(10**6))
    head, t = [word() for _ in range(24)], []
    for _ in range(6):
        base = head + [word() for _ in range(16)]
        # a chain: each text is at the edge of 0.8 to the one before and far from all others
        for _ in range(12):
            t.append(" ".join(base))
            base = base[:-1] + [word()] if rng.random() < 0.3 else base[1:] + [word()]
            base = [word(), *base]
    sets = [shingles(x) for x in t]
    want = components(range(len(t)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    # every text stands in one list, all of them too long
    monkeypatch.setattr(near, "list_keys", lambda prints: np.zeros((len(prints), 10), np.int64) + np.arange(10))
    for name, most in (("SHORT_LIST", 4), ("FEW", 5), ("BLOCK", 7)):
        monkeypatch.setattr(near, name, most)
    assert 6 <= len(set(want.values())) < len(t)
    assert {r.doc_id: r.component_id for r in near.near_copies(df).collect()} == want


def test_repeated_and_missing_ids(spark):
    same = "a b c d e f g"
    df = spark.createDataFrame([(1, same, "p"), (1, same, "p"), (2, same, "q"), (None, same, "r"), (None, "z y x", "s")], "doc_id long, text string, node string")
    kept = sorted((r.doc_id or -1, r.node) for r in near.one_of_each(df).collect())
    assert kept == [(-1, "r"), (-1, "s"), (1, "p")]
    assert near.one_of_each(df.limit(0)).count() == 0


def test_fingerprint_links_agree_with_brute_force(spark):
    t = texts()
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    fp = [simhash.fingerprint(x) for x in t]
    want = components(range(len(t)), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (fp[i], want[i]) for i in range(len(t))}


def test_no_component_is_held_in_one_row(spark):
    df = spark.createDataFrame(list(enumerate(texts()[:20])), "doc_id long, text string")
    assert "collect_list" not in simhash.near_duplicates(df)._jdf.queryExecution().toString()


def test_long_posting_list_links():
    rng = np.random.default_rng(1)
    for many in (900, 3000):
        fps = np.unique(rng.integers(0, 1 << 16, many, dtype=np.uint64) << np.uint64(8))
        got = simhash._link_bucket(fps, 2)
        near_by = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
        root = {int(f): i for i, f in enumerate(fps)}
        assert all(near_by[root[a], root[b]] for a, b in got)
        reached = components(range(len(fps)), lambda a, b: bool(near_by[a, b]))
        linked = {frozenset((root[a], root[b])) for a, b in got}
        assert components(range(len(fps)), lambda a, b: frozenset((a, b)) in linked) == reached


def test_odd_rows_have_defined_fingerprints(spark):
    kind = "doc_id long, text string, fp string, component_id string, node string"
    df = spark.createDataFrame([(None, "a b c", "x", "x", "x"), (5, "A B C", "x", "x", "x"), (5, "A B C", "x", "x", "x"), (7, None, "x", "x", "x"), (6, " ", None, None, None)], kind)
    got = sorted((r.doc_id or -1, r.fp == 0, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, False, 5), (5, False, 5), (5, False, 5), (6, True, 6), (7, True, 6)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_fingerprint_is_the_plain_definition():
    import xxhash

    for t in ["One two\tTHREE four", "a b", "", "É é x y z"]:
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
