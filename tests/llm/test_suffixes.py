"""Removal of repeated bytes against brute force."""

import hashlib
import random

from brindle.llm.suffixes import remove_repeats


def brute(rows):
    rank = lambda i: 1 << 62 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, 1 << 63), rank(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < rank(i):
                gone[k : k + 50] = [True] * 50
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bucket string")
    got = remove_repeats(df, **how).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(b - a for a, b in zip(r.starts, r.ends)), len(r.starts), r.kept_sha256) for r in got), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(["alpha", "bêta", "gamma", "delta", "naïve", "x"]) + str(rng.randrange(400)) for _ in range(n))
    common = [say(9), say(30), "a" * 170, "ab" * 60, "abc" * 50]
    rows = []
    for i in range(120):
        t = say(rng.randrange(1, 40))
        for _ in range(rng.randrange(3)):
            t += rng.choice(common) + say(rng.randrange(6))
        rows.append((i * 7, t))
    rows += [(1000, None), (1001, ""), (1002, "short"), (1003, rows[5][1]), (1004, "a" * 49), (1005, "a" * 50), (2, say(4000) + common[1])]
    rows += [(None, rows[9][1]), (None, say(30) + common[1]), (None, None), (70, rows[3][1]), (70, say(20) + common[0]), (70, rows[10][1]), (1003, rows[5][1])]
    return rows


def test_small_groups_agree_with_brute_force(spark):
    rows = corpus(3)
    assert found(spark, rows, group_bytes=3000) == brute(rows)


def test_many_buckets_and_groups_agree_with_brute_force(spark):
    rows = corpus(4)
    assert found(spark, rows, group_bytes=6000, buckets=17) == brute(rows)


def test_long_texts_are_cut_without_loss():
    import pyarrow as pa

    from brindle.llm import suffixes

    rows = corpus(5)
    piece, block = suffixes.PIECE, suffixes.BLOCK
    suffixes.PIECE, suffixes.BLOCK = 31 * 10, 40
    try:
        group = pa.table({"grp": pa.array([0] * len(rows), pa.int64()), "doc_id": pa.array([i for i, _ in rows], pa.int64()), "raw": pa.array([(t or "").encode() for _, t in rows], pa.binary())})
        sent = suffixes._send_names(3)(group)
        bits = pa.concat_tables([suffixes._rank_names(sent.filter(pa.array([b == k for b in sent.column("bucket").to_pylist()]))) for k in set(sent.column("bucket").to_pylist())])
        strings = suffixes._send_strings(3, 5)(group, bits)
        of = strings.column("bucket").to_pylist()
        found_at = pa.concat_tables([suffixes._least_documents(strings.filter(pa.array([b == k for b in of]))) for k in set(of)])
        got = suffixes._remove(True)(group, found_at).to_pylist()
    finally:
        suffixes.PIECE, suffixes.BLOCK = piece, block
    out = [(r["doc_id"], r["n_bytes"], sum(b - a for a, b in zip(r["starts"], r["ends"])), len(r["starts"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got]
    assert sorted(out, key=repr) == brute(rows)


def test_suffixes_are_in_order():
    import numpy as np

    from brindle.llm.suffixes import Suffixes

    rng = np.random.default_rng(3)
    unit = rng.integers(97, 99, 70, dtype=np.uint8)
    buf = np.concatenate([np.tile(unit, 9), rng.integers(97, 100, 400, dtype=np.uint8), np.full(300, 97, np.uint8), np.tile(unit, 4)])
    at = rng.permutation(len(buf) - 49)
    order, new = Suffixes(buf).sort(at)
    strings = [bytes(buf[i : i + 50]) for i in at[order]]
    assert strings == sorted(strings)
    assert new.tolist() == [True] + [a != b for a, b in zip(strings, strings[1:])]


def test_empty_table(spark):
    assert found(spark, []) == []
