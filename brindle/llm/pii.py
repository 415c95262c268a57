"""Personal data: exact base patterns, and gradient-boosted trees over broad candidates, all in SQL expressions."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.samples import bounded, kept_as, named_back, thinned
from brindle.session import table

#: Documents, and bytes of their texts, that the trees are fitted on, and planted texts beside them.
SAMPLE, SAMPLE_BYTES, PLANTED = 2000, 4 << 20, 3000
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")

# The base patterns. Each finds what its plain form finds (leftmost, greedy), but
# a search never starts inside a run that an earlier start has tried, and repeats keep no way
# back, so a long run of digits or letters costs its length and no stack.
LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Broad candidates, and words that stand near personal data.
BROAD = {
    "email": r"(?:\G|(?<=[\s<>(\[,;:\"']|^))[^\s@<>()\[\],;:\"']{1,64}+(?:@|\x20?[\[(]at[\])]\x20?)[^\s@<>()\[\],;:\"']++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:[.:][0-9]{1,3}){3,5}+",
    "card": r"(?<![0-9])[0-9]{3,19}+(?:[\x20.-][0-9]{2,8}+){0,5}+",
    "phone": r"(?<![0-9+(])(?:\+|\()?[0-9]{1,4}+[\x20()./-]{1,3}+[0-9]{2,5}+(?:[\x20()./-]{1,2}+[0-9]{2,5}+){1,4}+",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_-])",
}
CUES = r"(?i)(mail|phone|tel|call|mobile|fax|address|ip|card|visa|account|iban|token|key|secret|password|passwd)\W{0,4}$"
CONTEXT = 24
CHUNK = 1024


def let(value: Column, use) -> Column:
    """use(value) with value worked out once, however often use() names it."""
    return F.transform(F.array(value), use).getItem(0)


def running(values: Column, merge, zero) -> Column:
    """merge of all values before each place, by doubling the reach of each place: n log n steps."""

    def reach(acc: Column, r: Column) -> Column:
        step = F.pow(F.lit(2), r).cast("int")
        return F.transform(acc, lambda x, i: F.when(i >= step, merge(acc[F.greatest(i - step, F.lit(0))], x)).otherwise(x))

    def work(v: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(v))).cast("int") - 1, F.lit(0)))
        return let(F.aggregate(rounds, v, reach), lambda s: F.transform(v, lambda _, i: F.when(i > 0, s[F.greatest(i - 1, F.lit(0))]).otherwise(zero)))

    return let(values, work)


def count_below(ascending: Column, x: Column) -> Column:
    """How many values of an ascending array are below x, by halving."""
    field = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def half(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        return F.when(s["lo"] >= s["hi"], s).when(ascending[F.least(mid, F.size(ascending) - 1)] < x, field(mid + 1, s["hi"])).otherwise(field(s["lo"], mid))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ascending) + F.lit(1))).cast("int"))
    return F.aggregate(steps, field(F.lit(0), F.size(ascending)), half)["lo"]


#: Fields in this order sort by start, then kind.
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
CANDIDATE = "array<struct<start:int,kind:int,end:int,value:string,before:string,after:string>>"


def none() -> Column:
    return F.array().cast(SPAN)


def matches(text: Column, pattern: str, kind: int, context: bool = False) -> Column:
    """Spans (code points, end exclusive) of a pattern's matches, leftmost and without overlap.

    The pieces between matches and the matches themselves give lengths, whose
    running sum gives places. With context, a span also has up to CONTEXT
    characters before it and one after, as far as no other match stands there.
    """

    def spans(found: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda gaps: let(F.transform(gaps, lambda g: F.length(g)), lambda g: placed(found, gaps, g)))

    def placed(found: Column, gaps: Column, g: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(m) + g[i])

        def span(before: Column, m: Column, i: Column) -> Column:
            fields = [(before[i] + g[i]).alias("start"), F.lit(kind).alias("kind"), (before[i] + g[i] + F.length(m)).alias("end"), m.alias("value")]
            around = [F.right(gaps[i], F.lit(CONTEXT)).alias("before"), F.substring(gaps[i + 1], 1, 1).alias("after")]
            return F.struct(*fields, *(around if context else []))

        return let(running(steps, lambda a, b: a + b, F.lit(0)), lambda before: F.transform(found, lambda m, i: span(before, m, i)))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast(CANDIDATE if context else SPAN)
    return let(found, lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(empty))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def valid(kind: str, value: Column) -> Column:
    """Whether a base match holds what its kind asks for."""
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(12, 19), F.call_function("luhn_check", d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then kind. Texts without a digit or @ are not searched."""
    cheap = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}

    def kept(i: int, k: str) -> Column:
        return F.when(text.rlike(cheap[k]), F.filter(matches(text, PATTERNS[k], i), lambda m: valid(k, m["value"]))).otherwise(none())

    every = [kept(i, k) for i, k in enumerate(BASE)]
    return F.when(text.rlike("[0-9@]"), F.array_sort(F.concat(*every))).otherwise(none())


# ------------------------------------------------- candidates and their features

FEATURES = ("kind", "chars", "digits", "letters", "marks", "groups", "longest", "plus", "at", "dots", "luhn", "low_octets", "cue", "glued", "upper")


def features(c: Column) -> Column:
    """Format and context features of a candidate span with its context, as an array of doubles."""
    v = c["value"]

    def of(d: Column) -> Column:
        groups = F.filter(F.split(v, "[^0-9]+"), lambda g: g != "")
        letters = F.length(F.regexp_replace(v, r"[^\p{L}]+", ""))
        cols = [
            c["kind"],
            F.length(v),
            F.length(d),
            letters,
            F.length(v) - F.length(d) - letters,
            F.size(groups),
            F.array_max(F.concat(F.transform(groups, lambda g: F.length(g)), F.array(F.lit(0)))),
            v.startswith("+").cast("int"),
            v.contains("@").cast("int"),
            F.length(F.regexp_replace(v, r"[^.]+", "")),
            F.when(F.length(d).between(12, 19), F.call_function("luhn_check", d)).otherwise(False).cast("int"),
            F.forall(groups, lambda g: (F.length(g) <= 3) & (F.coalesce(g.try_cast("int"), F.lit(999)) <= 255)).cast("int"),
            c["before"].rlike(CUES).cast("int"),
            (c["before"].rlike(r"[\p{L}\p{N}]$") | c["after"].rlike(r"^[\p{L}\p{N}]")).cast("int"),
            F.length(F.regexp_replace(v, r"[^\p{Lu}]+", "")),
        ]
        return F.array(*[x.cast("double") for x in cols])

    return let(digits(v), of)


def candidates(text: Column) -> Column:
    """Broad spans of every kind, which may overlap, with the characters around them."""
    cheap = {"email": "@|[\\[(]at[\\])]", "ip": r"[0-9][.:][0-9]", "card": "[0-9]{3}", "phone": r"[0-9][ ()./-]", "secret": "[A-Za-z0-9_-]{20}"}
    every = [F.when(text.rlike(cheap[k]), matches(text, BROAD[k], i, context=True)).otherwise(F.array().cast(CANDIDATE)) for i, k in enumerate(KINDS)]
    return F.filter(F.concat(*every), lambda m: (m["kind"] != KINDS.index("secret")) | (m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]")))


# ------------------------------------------------- boosting (on a bounded sample, off the main path)


@dataclass
class Trees:
    trees: list
    base: float
    #: least score of each kind
    least: tuple[float, ...]

    def score(self, f: Column) -> Column:
        """Logit of a feature array, as nested CASEs."""

        def walk(t) -> Column:
            if isinstance(t, float):
                return F.lit(t)
            j, cut, left, right = t
            return F.when(f[j] <= cut, walk(left)).otherwise(walk(right))

        out = F.lit(self.base)
        for t in self.trees:
            out = out + walk(t)
        return out


def calibrated(score: np.ndarray, y: np.ndarray, likely: float) -> float:
    """The least score from which on the share of positives, made rising by pooling neighbours, is at least `likely`; infinity if none."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # positives, rows, least score
    for k in order:
        if pools and pools[-1][2] == score[k]:
            pools[-1][0] += y[k]
            pools[-1][1] += 1
        else:
            pools.append([y[k], 1, score[k]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            p, n, at = pools.pop()
            pools[-1][0] += p
            pools[-1][1] += n
    good = [at for p, n, at in pools if p >= likely * n and p >= 5]
    return float(min(good)) - 1e-9 if good else float("inf")


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.3, likely: float = 0.9) -> Trees | None:
    """Logistic gradient boosting; every third row, which the trees do not see, calibrates each kind's scores and sets its threshold."""
    if len(y) < 20 or y.min() == y.max():
        return None
    held = np.arange(len(y)) % 3 == 2
    xt, yt = x[~held], y[~held]
    p0 = np.clip(yt.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    f = np.full(len(yt), base)
    cuts = [np.unique(np.quantile(xt[:, j], np.linspace(0.02, 0.98, 33))) for j in range(x.shape[1])]
    trees = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, d: int):
        G, H = g[rows].sum(), h[rows].sum()
        leaf = float(rate * G / (H + 1))
        best = (1e-6, None, None)
        if d:
            for j in range(x.shape[1]):
                v = xt[rows, j]
                for c in cuts[j]:
                    left = v <= c
                    gl, hl = g[rows[left]].sum(), h[rows[left]].sum()
                    if hl < 1 or H - hl < 1:
                        continue
                    gain = gl * gl / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G * G / (H + 1)
                    if gain > best[0]:
                        best = (gain, j, float(c))
        if best[1] is None:
            return leaf
        _, j, c = best
        left = xt[rows, j] <= c
        return (j, c, grow(rows[left], g, h, d - 1), grow(rows[~left], g, h, d - 1))

    def value(t, rows: np.ndarray) -> np.ndarray:
        if isinstance(t, float):
            return np.full(len(rows), t)
        j, c, a, b = t
        left = rows[:, j] <= c
        out = np.empty(len(rows))
        out[left], out[~left] = value(a, rows[left]), value(b, rows[~left])
        return out

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        t = grow(np.arange(len(yt)), yt - p, p * (1 - p), depth)
        trees.append(t)
        f += value(t, xt)
    xv, yv = x[held], y[held]
    s = base + sum(value(t, xv) for t in trees)
    least = [calibrated(s[xv[:, 0] == k], yv[xv[:, 0] == k], likely) for k in range(len(KINDS))]
    return Trees(trees, base, tuple(least))


def planted(carriers: list[str], many: int, seed: int = 7) -> list[tuple[str, int, int, int, int]]:
    """`many` texts (text, start, end, kind, label): a made-up value set into a piece of a real text.

    Labels come from what was planted: addresses, numbers and secrets in the
    forms people write them, most of which no base pattern finds, against look-alikes
    (numbers without a check digit, versions, dates, sums, order numbers,
    digests, handles).
    """
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda a="abcdefghijklmnopqrstuvwxyz": "".join(r.choice(a) for _ in range(r.randrange(3, 10)))
    mixed = lambda n, a: "".join(r.choice(a) for _ in range(n))
    host = lambda: word() + r.choice([".org", ".com", ".example", ".co.uk"])
    user = lambda: word() + r.choice(["", ".", "_", "-"]) + word() + r.choice(["", num(2)])
    cue = lambda words, sure: r.choice(words) + r.choice([": ", " ", " = ", "="]) if sure or r.random() < 0.6 else ""

    def card(ok: bool) -> str:
        body = r.choice("3456") + num(14)
        total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, body)))
        check = -total % 10
        d = body + str(check if ok else (check + r.randrange(1, 10)) % 10)
        return r.choice(["", " ", "-", "."]).join(d[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(2 + r.randrange(2)), num(3), num(4)
        return r.choice([f"+{num(2)} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"0{a}/{b} {c}", f"+{num(1)} ({a}) {b} {c}", f"{a}.{b}.{c}"])

    hexes, letters = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    octet = lambda: str(r.randrange(256))
    quad = lambda: ".".join(octet() for _ in range(4)) + r.choice(["", "", ":" + str(r.randrange(80, 999))])
    good = {
        "email": lambda: (cue(["mail", "e-mail", "address"], False), user() + r.choice(["@", " [at] ", "(at)", "[at]"]) + host()),
        "ip": lambda: (cue(["ip", "address"], False), quad()),
        "card": lambda: (cue(["card", "visa", "account"], False), card(True)),
        "phone": lambda: (cue(["phone", "tel", "call", "mobile", "fax"], True), phone()),
        "secret": lambda: (cue(["token", "key", "secret", "password"], True) + r.choice(['"', "'", ""]), r.choice([mixed(40, hexes), mixed(r.randrange(20, 60), letters), "sk-" + mixed(32, letters)])),
    }
    bad = {
        "email": lambda: ("", r.choice(["@" + word(), word() + "@" + word()])),
        "ip": lambda: (r.choice(["v", "version ", ""]), ".".join(str(r.randrange(256, 999) if r.random() < 0.5 else r.randrange(20)) for _ in range(r.choice([4, 5])))),
        "card": lambda: (r.choice(["", "order ", "no. "]), card(False) if r.random() < 0.7 else num(r.randrange(4, 19))),
        "phone": lambda: (r.choice(["", "on ", "about ", "see "]), r.choice([f"20{num(2)}-0{num(1)}-1{num(1)}", f"{num(2)} {num(3)} {num(3)}", f"{num(2)}/{num(2)}/20{num(2)}", f"{num(2)}-{num(3)}-{num(2)}"])),
        "secret": lambda: (r.choice(["", "commit ", "see ", "id "]), r.choice([mixed(40, hexes), "-".join([word() for _ in range(4)] + [num(2)]), "_".join(word() + num(1) for _ in range(4))])),
    }
    out = []
    for k in range(many if carriers else 0):
        i, y = k % len(KINDS), k // len(KINDS) % 2
        lead, value = (good if y else bad)[KINDS[i]]()
        text = r.choice(carriers)
        at = r.randrange(max(1, len(text) - 160))
        left, right = text[at : at + 80], text[at + 80 : at + 160]
        head = left + " " + lead
        out.append((head + value + r.choice([" ", "\"", ", ", ". "]) + right, len(head), len(head) + len(value), i, y))
    return out


def fitted(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, many: int = PLANTED) -> Trees | None:
    """Trees from the candidates of at most `sample` documents and of `many` texts with planted values.

    There are no labels of personal data. In planted texts, a candidate that
    is the planted value has its label, one of its kind that overlaps it has
    none, and one of another kind there is harmless. In documents, a base match that holds counts as personal, a candidate that
    overlaps none and stands behind no announcing word counts as harmless, and
    all others have no label. So the trees must tell by form and context what
    the base patterns do not say: dotted cards, written-out @ signs, phone
    numbers without a plus, secrets.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    some = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    natural = [r.text for r in bounded(thinned(some, "doc_id", 2 * sample), sample, sample_bytes)]
    made = planted([t for t in natural if t.strip()], many)
    if not made:
        return None
    told = [(k, t, None, None, None, None) for k, t in enumerate(natural)] + [(len(natural) + k, *m) for k, m in enumerate(made)]
    df = docs.sparkSession.createDataFrame(told, "row int, text string, a int, b int, k int, y int")
    short = lambda c: F.struct(c["start"].alias("a"), c["end"].alias("b"), c["kind"].alias("k"))
    named = lambda c: c["before"].rlike(CUES)
    every = F.transform(candidates(text), lambda c: F.struct(short(c).alias("at"), features(c).alias("f"), named(c).alias("cue")))
    got = df.select("row", "a", "b", "k", "y", every.alias("c"), F.transform(base_spans(text), short).alias("base")).where(F.size("c") > 0).sort("row").collect()
    x, y = [], []
    for r in got:
        base = sorted((s.a, s.b, s.k) for s in r.base)
        for c in r.c:
            a, b, k = c.at
            if r.y is not None and a < r.b and r.a < b:
                label = r.y if (a, b, k) == (r.a, r.b, r.k) else (None if r.y and k == r.k else 0)
            elif r.y is not None:
                label = None
            elif (a, b, k) in base:
                label = 1
            else:
                label = 0 if not c.cue and not any(p < b and a < q for p, q, _ in base) else None
            if label is not None:
                x.append(c.f)
                y.append(label)
    return fit_trees(np.array(x), np.array(y, float)) if x else None


# ------------------------------------------------- spans and redaction


def all_spans(text: Column, base: Column, trees: Trees | None) -> Column:
    """Base spans and the candidates that the trees select and that touch no base span; by start, then kind."""
    if trees is None:
        return base

    def added(starts: Column, reach: Column) -> Column:
        """reach: where the base spans up to each one end at the latest."""

        def chosen(c: Column) -> Column:
            before = count_below(starts, c["end"])
            free = F.when(before > 0, reach[F.greatest(before - 1, F.lit(0))] <= c["start"]).otherwise(True)
            least = F.element_at(F.array(*[F.lit(x) for x in trees.least]), c["kind"] + 1)
            return free & let(features(c), lambda f: trees.score(f) >= least)

        return F.filter(candidates(text), chosen)

    ends = F.transform(base, lambda b: b["end"])
    upto = F.zip_with(running(ends, lambda a, b: F.greatest(a, b), F.lit(0)), ends, lambda a, b: F.greatest(a, b))
    picked = let(F.transform(base, lambda b: b["start"]), lambda starts: let(upto, lambda reach: added(starts, reach)))
    more = F.transform(picked, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["value"].alias("value")))
    return F.array_sort(F.concat(base, more))


def _found(docs: DataFrame, trees: Trees | None, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """Kept columns as kept_as names them, _pii_text, _pii_base, _pii_spans."""
    rows = docs.select(*kept_as(keep), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_pii_text"))
    t, kept = F.col("_pii_text"), [f"_k{i}" for i in range(len(keep))]
    both = let(base_spans(t), lambda b: F.struct(b.alias("base"), F.when(t.rlike(r"[0-9@]|[\[(]at[\])]"), all_spans(t, b, trees)).otherwise(b).alias("spans")))
    return rows.withColumn("_pii", both).select(*kept, "_pii_text", F.col("_pii.base").alias("_pii_base"), F.col("_pii.spans").alias("_pii_spans"))


def find_pii(docs: DataFrame, trees: Trees | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """docs -> kept columns, _pii_text, _pii_base and _pii_spans (arrays of start, end, kind number, value).

    Every row gives one row; null texts are empty and have no span. Nothing is
    shuffled. Other columns pass if named in keep; where a kept column has a
    result's name, the result's name gets an underscore more.
    """
    return named_back(_found(docs, trees, keep, text_col), keep, ("_pii_text", "_pii_base", "_pii_spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat(name(s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span, or run of overlapping spans, replaced by [KIND] of the first."""
    tag = lambda k: F.element_at(F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS]), k + 1)

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        """Characters a to b, from chunks of CHUNK characters each: cutting one piece never walks the whole text."""
        i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        chunk = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
        start = F.substring(chunk(i), a % CHUNK + 1, F.when(i == j, b - a).otherwise(F.lit(CHUNK)))
        between = F.when(j - i > 1, F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")).otherwise("")
        return F.when(i == j, start).otherwise(F.concat(start, between, F.substring(chunk(j), F.lit(1), b % CHUNK)))

    def pieces(chunks: Column, done: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            return F.when(s["start"] >= done[i], F.concat(piece(chunks, done[i], s["start"]), tag(s["kind"]))).otherwise("")

        return F.concat(F.array_join(F.transform(spans, one), ""), piece(chunks, F.array_max(ends), F.length(text)))

    ends = F.transform(spans, lambda s: s["end"])
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    whole = let(cut, lambda chunks: let(running(ends, lambda a, b: F.greatest(a, b), F.lit(0)), lambda done: pieces(chunks, done)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def without_pii(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """docs with personal data in texts replaced, and n_chars (if there) counted anew; null texts stay null, other columns as they are, whatever their names."""
    own = {k: F.col(f"_k{i}") for i, k in enumerate(docs.columns)}
    found = _found(docs, trees, tuple(docs.columns), "text")
    text = F.when(own["text"].isNotNull(), redacted(F.col("_pii_text"), F.col("_pii_spans")))
    found = found.withColumn("_new", text)
    own["text"] = F.col("_new")
    if "n_chars" in own:
        own["n_chars"] = F.length("_new").cast(docs.schema["n_chars"].dataType)
    return found.select(*[c.alias(k) for k, c in own.items()])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, fitted(docs))

    def count(i: int) -> Column:
        return F.size(F.filter("_pii_base", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("_pii_base")), 256).alias("base_sha256"), joined(F.col("_pii_spans")).alias("spans"))
