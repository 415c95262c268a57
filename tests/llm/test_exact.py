"""Operators with exact results: chat, media, personal data, decontamination, mixing."""

import hashlib
import re
import zlib

import numpy as np

from brindle.llm import chat, decontaminate, media, mixing, pii

TEXTS = [
    None,
    "",
    "a" * 63,
    "é" * 64,
    "mail a.b@c-d.org or x@y.z.q, ip 10.0.0.256 and 192.168.1.1.7 0001.2.3.4",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and +49 (30) 1234-5678 or +1 2",
    "a@b c@d.e@f.g 5500000000000004 1.2.3.4@5.6.7.8 +123456789012345678",
    "token: abcdEFGH1234ijklMNOP5678 " + "9" * 3000 + " x" * 500,
    "ß" * 10 + " 4242424242424242 " + "語" * 5 + " me@host.example",
]


def frame(spark):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, value string")


# ---------------------------------------------------------------- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def good(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def base(text):
    found = [(m.start(), k, m.end(), kind) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text or "") if good(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_base_spans_are_the_plain_patterns(spark):
    import pandas as pd

    from pyspark.sql import functions as F

    own = frame(spark).select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(own)

    got = pii.find_pii(docs, None).select("doc_id", pii.joined(F.col("_pii_base")).alias("b")).toPandas().set_index("doc_id").b
    texts: pd.Series = docs.toPandas().set_index("doc_id").text
    assert {i: base(t) for i, t in texts.items()} == got.to_dict()


def test_redaction_keeps_the_rest(spark):
    out = {r.doc_id: r for r in pii.without_pii(frame(spark), None).collect()}
    assert out[0].text is None and out[2].text == TEXTS[2] and out[0].value == "s"
    assert out[8].text == "ß" * 10 + " [CARD] " + "語" * 5 + " [EMAIL]"
    assert pii.without_pii(frame(spark).limit(0), None).count() == 0


def test_op7_adds_spans_and_keeps_base(spark):
    for r in pii.op7(spark, "/root/testdata/sf0.001").collect():
        spans = r.spans.split(",") if r.spans else []
        own = [s for s in spans if s.split(":")[0] != "secret"]
        assert len(own) >= r.n_email + r.n_ip + r.n_card + r.n_phone


def test_added_spans_are_the_planted_values(spark):
    """Values planted in other documents, in forms that the base patterns mostly miss: precision and recall of each kind."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = pii.fitted(docs)
    assert trees is not None
    carriers = [r.text for r in docs.where("text is not null and length(text) > 200 and not text rlike '[0-9@]'").orderBy("doc_id").limit(300).collect()]
    made = pii.planted(carriers, 2500, seed=99)
    df = spark.createDataFrame([(i, m[0]) for i, m in enumerate(made)], "doc_id long, text string")
    got = {r.doc_id: {(x.start, x.end, x.kind) for x in r._pii_spans} for r in pii.find_pii(df, trees).collect()}
    base = {r.doc_id: {(x.start, x.end, x.kind) for x in r._pii_base} for r in pii.find_pii(df, None).collect()}
    assert all(base[i] <= got[i] for i in got)
    added_right = 0
    for k, least in enumerate((0.6, 0.6, 0.8, 0.5, 0.6)):
        right = sum((a, b, kind) in got[i] for i, (_, a, b, kind, y) in enumerate(made) if kind == k and y)
        plain = sum((a, b, kind) in base[i] for i, (_, a, b, kind, y) in enumerate(made) if kind == k and y)
        wrong = sum((a, b, kind) in got[i] - base[i] for i, (_, a, b, kind, y) in enumerate(made) if kind == k and not y)
        of = sum(kind == k and y for _, _, _, kind, y in made)
        added_right += right - plain
        assert right >= least * of and wrong <= 0.12 * of, (pii.KINDS[k], right, plain, wrong, of)
    assert added_right >= 300


def test_running_and_halving(spark):
    from pyspark.sql import functions as F

    lists = [[], [5], [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5], list(range(100))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, v array<int>")
    got = df.select("i", pii.running(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("s"), pii.running(F.col("v"), lambda a, b: F.greatest(a, b), F.lit(0)).alias("m")).collect()
    for r in got:
        v = lists[r.i]
        assert r.s == [sum(v[:k]) for k in range(len(v))] and r.m == [max(v[:k], default=0) for k in range(len(v))]
    below = df.select("i", F.transform(F.array(*[F.lit(x) for x in (-1, 0, 1, 5, 6, 99, 200)]), lambda x: pii.count_below(F.array_sort("v"), x)).alias("n")).collect()
    for r in below:
        assert r.n == [sum(y < x for y in lists[r.i]) for x in (-1, 0, 1, 5, 6, 99, 200)]


def test_a_long_text_full_of_spans_is_redacted_whole(spark):
    line = "write to me{0}@host{0}.org or 語語 4242424242424242 now\n"
    text = "".join(line.format(k) for k in range(30000)) + "end" + "z" * 3000
    df = spark.createDataFrame([(1, text), (1, text[:2048]), (None, text[:1024])], "doc_id long, text string")
    want = "write to [EMAIL] or 語語 [CARD] now\n" * 30000 + "end" + "z" * 3000
    assert max((r.text for r in pii.without_pii(df, None).collect()), key=len) == want


# ---------------------------------------------------------------- media


def test_payload_round_trip(spark):
    got = {r.doc_id: r for r in media.media_features(media.to_media(frame(spark)), ("doc_id", "n_bytes")).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.width % 8 == 0
    assert got[0].media_sha256 == got[1].media_sha256


def test_damaged_media_keep_their_row(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xff\xd8junk")), (2, None), (3, bytearray(b""))], "doc_id long, media binary")
    rows = {r.doc_id: r for r in media.media_features(df).collect()}
    assert len(rows) == 3 and rows[1].width is None and rows[2].media_sha256 is None


def test_thumbnail_is_the_dc_image():
    raw = np.arange(64 * 9, dtype=np.uint8)
    got = media.decode(media.encode(raw, np.array([0, len(raw)])))[0]
    assert got is not None and got[2].shape == (3, 3)
    dc = got[1].reshape(-1, 64)[:, 0].astype(int)
    assert (got[2].ravel() == np.clip(np.round(dc / 8 + 128), 0, 255)).all()


# ---------------------------------------------------------------- chat


def test_chat_reads_back_what_was_said(spark):
    turns = [(1, 0, "user", "hi <|end|> \\e </s>"), (1, 1, "assistant", "[INST] \\ <<SYS>> <|assistant|>"), (2, 0, "assistant", None), (2, 1, "odd|>role", "a\n"), (3, 0, "user", "x" * 200000), (3, 1, "assistant", "é")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, loss string")
    segments = chat.format_segments(df)
    for r in segments.where("part = 1").collect():
        assert not any(c in r.segment for c in chat.Template().controls)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    for c in (1, 2, 3):
        mine = [t for t in turns if t[0] == c]
        said = "".join(f"{t[2]}\n{t[3] or ''}\n" for t in mine)
        loss = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].valid and not got[2].valid and got[3].valid
    assert chat.read_back(chat.format_segments(df.limit(0))).count() == 0


def test_op5_agrees_with_plain_reading(spark):
    p = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").toPandas().sort_values(["conv_id", "turn"], kind="stable")
    want = {-7: ("user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n", "</s>[INST] ok [/INST]")}
    for c, g in p.groupby("conv_id"):
        t = g.text.fillna("")
        want[c] = ("".join(f"{r}\n{x}\n" for r, x in zip(g.role, t)), "".join(x for r, x in zip(g.role, t) if r == "assistant"))
    got = {r.conv_id: (r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op5(spark, "/root/testdata/sf0.001").collect()}
    assert got == {c: (hashlib.sha256(a.encode()).hexdigest(), len(b), hashlib.sha256(b.encode()).hexdigest()) for c, (a, b) in want.items()}


# ---------------------------------------------------------------- decontamination


def test_leaks_and_new_parameters_are_caught(spark):
    item = "A train leaves at 9 am with Maria on board and drives 120 km in 2 hours before it stops for Peter at the station"
    other = item.replace("9", "7").replace("Maria", "Julia").replace("120", "340").replace("2 hours", "5 hours").replace("Peter", "Oskar")
    twisted = "A train leaves at 9 am and the river keeps its colour while nobody counts the birds over the old harbour wall"
    docs = spark.createDataFrame([(1, "Before. " + item + ". After it.", 0), (2, other, 0), (3, twisted, 0), (4, None, 0), (5, "", 0), (None, item, 0), (1, item, 0)], "doc_id long, text string, share int")
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "two words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert {(1, 10), (2, 10)} <= got and not any(d in (3, 4, 5) for d, _ in got)
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {3, 4, 5, None}
    shuffled = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, most_broadcast=0).collect()}
    assert shuffled == got
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


def found(spark, docs, items, **how):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b, **how).collect()}


def test_names_count_wherever_they_stand(spark):
    tom = "Tom has 5 apples. Tom buys 3 more apples. How many apples does Tom have?"
    long = "Anna and Karl walk 12 km along the river.\nKarl carries the bag, says \"Anna is slow\" and waits  Karl rests for 9 minutes"
    ann = tom.replace("Tom", "Ann").replace("5", "7").replace("3", "2")
    other = "Ann saw the sea. It was cold and the boats were all gone when the rain began to fall on the town again"
    docs = [ann, tom.lower(), long.replace("\n", " "), long.replace("Anna", "Ruth").replace("Karl", "Otto").replace(" ", "\n"), other, "Ann Lee runs"]
    assert found(spark, docs, [tom, long, "Tom Smith", "Apples fall"]) == {(0, 0), (1, 0), (2, 1), (3, 1)}


def test_an_item_beside_its_variants_is_caught(spark):
    item = "the pump fills 10 tanks in 20 minutes while the drain empties 30 tanks in 40 minutes and the guard counts 50 tanks"
    values = [(90, 80, 70, 60, 95), (11, 92, 13, 84, 15), (99, 18, 77, 16, 96)]
    variants = []
    for v in values:
        t = item
        for old, new in zip((10, 20, 30, 40, 50), v):
            t = t.replace(str(old), str(new))
        variants.append(t)
    late = variants[1].replace("while the", "while in the same yard the")
    mixed = item.replace("10", "50").replace("30 tanks", "20 tanks")
    sheets = [" . ".join(x) for x in ([item, *variants], [*variants, item], variants, [late, variants[0], variants[2]])]
    assert found(spark, [*sheets, mixed], [item]) >= {(0, 0), (1, 0), (2, 0), (3, 0)}
    assert found(spark, sheets, [item], most_broadcast=0) == found(spark, sheets, [item])


def plain_tokens(text):
    import regex

    d = decontaminate
    t = (text or "").replace("\u0001", " ")
    t = regex.sub(r"(?i)(?<=[0-9])( ?)(" + "|".join(sorted(d.UNITS, key=lambda u: (-len(u), u))) + r")(?![\p{L}\p{N}])", lambda m: " " + d.UNIT + m[2], t)
    t = regex.sub(r"(?<![\p{L}\p{N}\u0001])[0-9]++(?:[.,][0-9]++)*+", lambda m: d.NUMBER + m[0], t)
    t = regex.sub(r"(?<=[0-9])[.,](?=[0-9])", "", t)
    words = {w.capitalize() for w in d.FUNCTION_WORDS}
    named = lambda m: m[0] if m[0] in words else d.NAME + m[0]
    t = regex.sub(r"(?<![\p{L}\p{N}\u0001])\p{Lu}\p{Ll}[\p{L}\p{N}]*", named, t)
    return [x for x in regex.split(r"[^\p{L}\p{N}\u0001]+", t.lower()) if x]


def plain_windows(tok, n, item):
    """(place, template, form, slots) of all windows of n tokens; numbers and units of an item carry their place."""
    d = decontaminate
    out = []
    for i in range(len(tok) - n + 1):
        win = tok[i : i + n]
        slot = [(x if x.startswith(d.NAME) or not item else (x, i + k)) for k, x in enumerate(win) if x[0] == "\u0001"]
        name = lambda x: (x if isinstance(x, str) else x[0]).startswith(d.NAME)
        template = tuple(x[:2] if x[0] == "\u0001" else x for x in win)
        first = tuple(x[2:] if x.startswith(d.NAME) else x[:2] if x[0] == "\u0001" else x for x in win)
        names, words = sum(map(name, slot)), n - len(slot)
        out.append((i + 1, template, first, tuple(x for x in slot if not name(x))))
        if names and words > (names if n < d.WINDOW else 0):
            out.append((i + 1, template, template, tuple(slot)))
    return out


def plain_contaminated(docs, items):
    from collections import defaultdict

    value = lambda x: x if isinstance(x, str) else x[0]
    own, lengths = defaultdict(set), set()
    for i, t in items:
        tok = plain_tokens(t)
        if tok:
            lengths.add(min(8, len(tok)))
            own[i] |= set(plain_windows(tok, min(8, len(tok)), True))
    out = {}
    for doc in {d for d, _ in docs}:
        seen = {(x, hash(t)) for d, t in docs if d == doc for n in lengths for x in plain_windows(plain_tokens(t), n, False)}
        for item, mine in own.items():
            total = len({w for _, w, _, _ in mine})
            half = max(total // 4, 1) * 2
            groups = defaultdict(dict)
            for (at, _, form, slots), body in seen:
                for item_at, w, item_form, item_slots in mine:
                    if form != item_form:
                        continue
                    o = at - item_at
                    pairs = tuple(zip(item_slots, slots))
                    rank = (sum(value(a) != b for a, b in pairs), -len(slots), [(str(value(a)), str(b)) for a, b in pairs])
                    for g in ((0,), (1, body, o), (2, body, o // half), (3, body, (o + half / 2) // half)):
                        have = groups[g].get((w, item_at))
                        if have is None or rank < have[0]:
                            groups[g][(w, item_at)] = (rank, pairs)
            good = []
            for found_at in groups.values():
                matched = len({w for w, _ in found_at})
                pairs = {p for _, ps in found_at.values() for p in ps}
                slots = len({a for a, _ in pairs})
                if matched >= 0.5 * total and (len(pairs) - slots) * 2 <= slots:
                    good.append(matched)
            if good:
                out[doc, item] = (total, max(good))
    return out


def test_decontamination_agrees_with_plain_windows(spark):
    import random

    rng = random.Random(6)
    names, words = ["Tom", "Ann", "Karl", "Otto Lee"], ["apples", "the", "walks", "river", "Then", "near", "red", "buys", "of"]
    part = lambda: rng.choice(words + [rng.choice(names), str(rng.randrange(1, 9)), f"{rng.randrange(2, 40)} km", "1,5 h"])
    items = [(i, " ".join(part() for _ in range(rng.choice([1, 3, 8, 14, 25])))) for i in range(14)] + [(20, None), (21, "..."), (3, "Ann buys 5 red apples near the river of Karl")]
    items.append((22, "Ada has 5 pens and buys 5 more and 5 again before she counts all the pens"))
    docs = []
    for d in range(60):
        text = [part() for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(3)):
            t = rng.choice(items)[1] or ""
            if rng.random() < 0.6:
                for a, b in (("Tom", "Ruth"), ("Ann", "Ida"), ("5", str(rng.randrange(9))), ("km", "m"), ("3", "7")):
                    t = t.replace(a, b) if rng.random() < 0.5 else t
            cut = t.split()
            if cut and rng.random() < 0.4:
                cut.insert(rng.randrange(len(cut)), "extra")
            text += cut + [part() for _ in range(rng.randrange(4))]
        docs.append((rng.randrange(50), " ".join(text)))
    docs += [(60, None), (61, ""), (62, "Ada has 5 pens and buys 6 more and 8 again before she counts all the pens"), (63, docs[0][1] * 40)]
    want = plain_contaminated([(d, t) for d, t in docs if t is not None], items)
    d = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, slots string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, share int")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_matched) for r in decontaminate.contaminated(d, b).collect()}
    assert got == want and (62, 22) in got and len(got) > 20
    unfiltered = {(r.doc_id, r.item_id): (r.n_windows, r.n_matched) for r in decontaminate.contaminated(d, b, most_begins=0).collect()}
    assert unfiltered == want


# ---------------------------------------------------------------- chat, formatted text


def test_formatted_text_is_read_by_its_marks_alone():
    t = chat.Template()
    turns = [("user", "x<|y"), ("assistant", "ends with <"), ("a|", "|> \\e"), ("assistant", "")]
    esc = lambda x: re.sub("|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in t.controls), lambda m: t.mark, x.replace("\\", "\\\\"))
    whole, mask = "", []
    for role, text in turns:
        for piece, loss in ((f"<|{esc(role)}|>", False), (esc(text), role == "assistant"), (t.close, False)):
            whole += piece
            mask += [loss] * len(piece)
    want = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
    for size in (1, 3, len(whole)):
        r = chat.Reader(t)
        for k in range(0, len(whole), size):
            for ch, loss in zip(whole[k : k + size], mask[k : k + size]) if size > 1 else [(whole[k], mask[k])]:
                r.feed(ch, loss)
        assert (r.n, r.turns.hexdigest(), r.chars) == (4, want, len(whole)) and r.at_end() and r.ok
        assert (r.loss_chars, r.loss.hexdigest()) == (11, hashlib.sha256(b"ends with <").hexdigest())
    r.feed("<|user|>no end", False)
    assert not r.at_end()


def test_odd_conversations_have_rows(spark):
    rows = [(None, None, "user", "a"), (None, None, "assistant", "b"), (4, 1, "user", "q"), (4, 1, "user", "q"), (4, None, None, None), (5, 0, "user", "q")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    got = {r.conv_id: (r.n_turns, r.valid, r.loss_chars) for r in chat.read_back(chat.format_segments(df)).collect()}
    assert got == {None: (2, False, 1), 4: (3, False, 0), 5: (1, False, 0)}


# ---------------------------------------------------------------- mixing


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 50), ["a", "b", "c", None][min(3, i % 7)], i) for i in range(4000)] + [(9001, None, "a", 0), (9002, "", "d", 0), (9002, "", "d", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    taken, target, whole = {}, {}, {}
    for r in got:
        s = r._row.source
        taken[s] = taken.get(s, 0) + r.copies * r.size
        target[s], whole[s] = r.target, r.source_size
        assert 0 <= r.copies <= 3
    assert abs(sum(target.values()) - sum(whole.values())) < 1e-6 * sum(whole.values())
    for s, t in target.items():
        assert t <= 3 * whole[s] + 1e-6 and abs(taken[s] - t) <= max(60, 0.01 * t)
    again = {(r._row.doc_id, r.copies) for r in mixing.mix_sources(df.repartition(7)).collect()}
    assert again == {(r._row.doc_id, r.copies) for r in got}
    assert mixing.mixed_documents(df).count() == sum(r.copies for r in got)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_mix_of_one_size_and_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 50)
    monkeypatch.setattr(mixing, "BLOCK", 3)
    rows = [(i % 900, f"w{i % 7} x", "a", i) for i in range(2000)] + [(1, "y z", "b", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _class int")
    one = sorted(tuple(r) for r in mixing.mixed_documents(df).collect())
    assert one == sorted(tuple(r) for r in mixing.mixed_documents(df.repartition(5)).collect())
    taken = {s: sum(2 for r in one if r[2] == s) for s in "ab"}
    target = {r._row.source: r.target for r in mixing.mix_sources(df).collect()}
    assert all(abs(taken[s] - target[s]) <= 2 for s in taken)
