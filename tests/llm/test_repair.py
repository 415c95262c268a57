"""Repair of conversations against a plain search for the cheapest, then least, letters."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from brindle.llm import repair
from brindle.session import table

NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain_faults(rows):
    """rows in order: (role, text) -> fault of each."""
    seen, out = set(), []
    for role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        if not words:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, letters, repaired rows), the least of all by cost and letters: the best way on from each place and state, from behind."""
    faults = plain_faults(rows)
    far = (1 << 30, "", ())
    best = {q: (0, "", ()) if q in ("", "a") else far for q in NEXT}

    def with_inserts(best):
        for _ in range(4):
            for q in NEXT:
                for x in NEXT[q]:
                    if x in "ua":
                        c, w, r = best[x]
                        best[q] = min(best[q], (c + 3, "I" + w, ((repair.NAME[x], ""), *r)), key=lambda v: v[:2])
        return best

    best = with_inserts(best)
    for (role, text), fault in zip(reversed(rows), reversed(faults)):
        new = {}
        for q in NEXT:
            c, w, r = best[q]
            ways = [(c + 4, "D" + w, r)]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                for x in NEXT[q]:
                    c, w, r = best[x]
                    if role[:1] == x:
                        ways.append((c + more, "K" + w, ((role, text), *r)))
                    if x in "ua":
                        ways.append((c + 3 + more, "R" + w, ((repair.NAME[x], text), *r)))
            new[q] = min(ways, key=lambda v: v[:2])
        best = with_inserts(new)
    return best[""]


def plain_damage(conv, turn, role, text):
    role, text = (" " if x is None else x for x in (role, text))
    h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
    return [] if h == 0 else [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)


def plain_row(conv, rows):
    """rows: (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    said = [(r, t) for _, r, t in rows]
    faults = plain_faults(said)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
    cost, letters, fixed = plain_repair(said)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
    return (conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, letters, sha)


def expected(rows):
    """rows: (conv, turn, role, text) of the table -> the query's rows."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).extend(plain_damage(conv, turn, role, text))
    return sorted((plain_row(c, r) for c, r in convs.items()), key=lambda r: (r[0] is not None, r[0] or 0))


def fixed(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0))


def test_query_rows(spark, sf):
    rows = [tuple(r) for r in table(spark, sf.replace("0.001", "0.01"), "conversations").select("conv_id", "turn", "role", "text").collect()]
    out = repair.op13(spark, sf.replace("0.001", "0.01"))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert fixed(out.collect()) == expected(rows)


def made(rng, n):
    roles, texts = ["system", "user", "assistant", "tool", "", "a2", None], ["Yes.", "No!", "cut", " ", "", "More?\n", "é", None]
    return [(rng.choice([None, *range(9)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("segment", [1, 3, 1 << 15])
def test_made_up_conversations_in_segments(spark, tmp_path, monkeypatch, segment):
    """Null turns, roles, texts and ids, ties, strange roles; cut into segments of one row, a few, or none; odd column names beside."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = made(random.Random(segment), 150)
    spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, seg int, `a.b` int").write.parquet(f"{tmp_path}/conversations.parquet")
    assert fixed(repair.op13(spark, str(tmp_path)).collect()) == expected(rows)


def test_tight_edits_of_any_rows():
    rng = random.Random(1)
    for _ in range(3000):
        said = [(r or " ", t or " ") for _, _, r, t in made(rng, rng.randrange(1, 9))]
        faults = plain_faults(said)
        codes = np.array([repair.INITIALS.find(r[:1]) % 4 if r[:1] in tuple("sua") else 3 for r, _ in said])
        codes = codes + np.array([4 * (f in ("blank", "duplicate")) + 8 * (f == "truncated") for f in faults])
        far = repair.FAR
        edits, _ = repair.tight_edits(codes, np.array([0, far, far, far]), repair.LAST, True)[0]
        cost, letters, _ = plain_repair(said)
        assert "".join(x for x, _, _ in edits) == letters
        assert int((repair.passage(codes)[0] + repair.LAST).min()) == cost


def test_odd_tables(spark, tmp_path):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    none.write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert repair.op13(spark, f"{tmp_path}/a").collect() == []
    long = [(1, k, ("user", "assistant")[k % 2], "x " * 50_000 + f"{k}.") for k in range(4)] + [(1, k, "user", "Again.") for k in range(4, 40)]
    spark.createDataFrame(long, none.schema).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert fixed(repair.op13(spark, f"{tmp_path}/b").collect()) == expected(long)
    whole, rows = repair.repair(spark.createDataFrame([("c", 0, "user", "Hi."), ("c", 1, "assistant", "Yes.")], "conv_id string, turn int, role string, text string"))
    assert [(r.conv_id, r.cost, r.audit) for r in whole.collect()] == [("c", 0, "KK")] and rows.count() == 2
