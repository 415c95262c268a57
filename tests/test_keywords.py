"""Keywords, passages and vocabularies against plain readings of word lists."""

import random
import re

from brindle.operators import keywords as kw
from brindle.operators import vocabulary as voc

WORD = re.compile(kw.WORD)


def same(found, wanted):
    return found in (wanted, wanted + "s", wanted + "es")


def plain_find(fields, ask):
    """(field, kind, first, last) of the best hit, or None."""
    q = [w.lower() for w in WORD.findall(ask)]
    if not q:
        return None
    for f, text in enumerate(fields):
        w = [x.lower() for x in WORD.findall(text or "")]
        for i in range(len(w) - len(q) + 1):
            if all(same(w[i + k], x) for k, x in enumerate(q)):
                return f, "phrase", i, i + len(q) - 1
        if f == 0 and len(q) > 1:
            for m in range(1, len(q) + kw.NEAR + 1):
                for i in range(len(w) - m + 1):
                    if all(any(same(x, y) for x in w[i : i + m]) for y in q):
                        return f, "near", i, i + m - 1
    return None


def test_hits_are_those_of_reading_every_field(spark):
    rng = random.Random(4)
    some = ["ai", "Engineer", "engineers", "software", "C++", ".net", "node.js", "of", "the", "boxes", "box", "data"]
    text = lambda n: rng.choice(["", " "]) + " ".join(rng.choice(some) + rng.choice(["", ",", ".", " /"]) for _ in range(rng.randrange(n)))
    docs = [(k, text(9), text(40) if k % 7 else None) for k in range(120)]
    asks = [(k, " ".join(rng.choice(some).lower() for _ in range(rng.randrange(1, 4)))) for k in range(25)] + [(25, "?!"), (26, ""), (27, "absent"), (28, "the the"), (29, "ai absent")]
    got = kw.find_keywords(spark.createDataFrame(docs, "id long, title string, body string"), "id", ["title", "body"], spark.createDataFrame(asks, "q long, ask string"), "q", "ask").collect()
    want = {(q, d): hit for q, ask in asks for d, *fields in docs if (hit := plain_find(fields, ask))}
    assert {(r.question, r.doc): (r.field, r.kind, r["first"], r["last"]) for r in got} == want and len(got) == len(want) > 200
    for r in got:
        w = WORD.findall(docs[r.doc][1 + r.field])
        assert r.match == " ".join(w[r["first"] : r["last"] + 1])
        assert r.before == ("… " if r["first"] > 2 else "") + " ".join(w[max(0, r["first"] - 2) : r["first"]])
        assert r.after == " ".join(w[r["last"] + 1 : r["last"] + 3]) + (" …" if r["last"] + 3 < len(w) else "")


def test_words_as_they_are_read():
    read = lambda t: [w.lower() for w in WORD.findall(t)]
    assert read("C++, C# and .NET on node.js. The end.") == ["c++", "c#", "and", ".net", "on", "node.js", "the", "end"]


def test_passages(spark):
    rng = random.Random(9)
    docs = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(30)))) for k in range(60)]
    asks = [(0, "a b c"), (1, "h zz"), (2, "c c"), (3, "zz")]
    terms = spark.createDataFrame([(q, w) for q, ask in asks for w in ask.split()], "question long, word string")
    pairs = spark.createDataFrame([(q, d) for q, _ in asks for d, _ in docs if (q + d) % 5], "question long, doc long")
    got = {(r.question, r.doc): (r.held, r["first"], r["last"]) for r in kw.top_passages(spark.createDataFrame(docs, "id long, t string"), "id", "t", pairs, terms).collect()}
    want = {}
    for q, ask in asks:
        for d, t in docs:
            w = t.split()
            held = set(ask.split()) & set(w)
            if held and (q + d) % 5:
                m, i = min((m, i) for m in range(1, len(w) + 1) for i in range(len(w) - m + 1) if held <= set(w[i : i + m]))
                want[q, d] = (len(held), i, i + m - 1)
    assert got == want


def test_segmentation_is_leftmost_and_longest(spark):
    rng = random.Random(2)
    letters = "a b c d".split()
    spelt = sorted({" ".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4]))) for _ in range(30)} - {"a"})
    vocabulary = [(f"e{k}", s if k % 5 else s.upper(), k % 5 == 0) for k, s in enumerate(spelt)] + [("none", "?", False), ("null", None, None)]
    docs = [(k, " ".join(rng.choice(letters + ["A", "B", "x"]) for _ in range(rng.randrange(40)))) for k in range(80)] + [(80, None), (81, "")]
    df = spark.createDataFrame(vocabulary, "entry string, spelling string, cased boolean")
    got = sorted((r.doc, r.pos, r.n, r.entry, r.said) for r in voc.segmented(voc.spans(spark.createDataFrame(docs, "id long, t string"), "id", "t", df)).collect())
    cased = {s: e for e, s, c in vocabulary if c}
    loose = {s.lower(): e for e, s, c in vocabulary if s and not c}
    want = []
    for d, t in docs:
        w, i = (t or "").split(), 0
        while i < len(w):
            for n in (4, 3, 2, 1):
                said = " ".join(w[i : i + n])
                entry = cased.get(said) or loose.get(said.lower())
                if i + n <= len(w) and entry:
                    want.append((d, i, n, entry, said))
                    i += n
                    break
            else:
                i += 1
    assert got == want and len(want) > 300
    assert voc.segmented(voc.spans(spark.createDataFrame(docs, "id long, t string"), "id", "t", df.limit(0))).count() == 0


def test_questions_of_the_same_words_are_searched_for_once(spark, monkeypatch):
    rng = random.Random(8)
    some = ["as", "a", "box", "boxes", "of", "the", "data", "go"]
    docs = [(k, " ".join(rng.choice(some) for _ in range(rng.randrange(12))), " ".join(rng.choice(some) for _ in range(rng.randrange(30)))) for k in range(60)]
    texts = ["the the", "a as", "of box", "data go the", "box", "go a data of"]
    asks = [(k, texts[k % 6].upper() if k % 4 else texts[k % 6] + "?") for k in range(48)]
    want = {(q, d): hit for q, ask in asks for d, *fields in docs if (hit := plain_find(fields, ask))}
    looked, hits = [], kw._hits
    monkeypatch.setattr(kw, "_hits", lambda read, part, near: looked.append(part.count()) or hits(read, part, near))
    for most in (50_000, 2):
        monkeypatch.setattr(kw, "ASKS", most)
        monkeypatch.setattr(kw, "HITS", most)
        looked.clear()
        got = kw.find_keywords(spark.createDataFrame(docs, "id long, title string, body string"), "id", ["title", "body"], spark.createDataFrame(asks, "q long, ask string"), "q", "ask").collect()
        assert {(r.question, r.doc): (r.field, r.kind, r["first"], r["last"]) for r in got} == want and len(got) == len(want) > 500
        assert sum(looked) == 6 and len(looked) == (1 if most > 6 else 3)
