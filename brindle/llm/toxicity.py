"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text, with exception phrases."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.samples import fold_of, kept_as, kept_schema, labelled_texts, named_back, unused
from brindle.session import table

#: Labelled documents, and bytes of their texts, that a lexicon is fitted on.
SAMPLE, SAMPLE_BYTES = 6000, 16 << 20
THRESHOLD = 0.3
LEAST_CONTEXTS = 6
LEAST_WEIGHT = 1.5

# Look-alike letters, digit substitutions and phrases that excuse a lexicon term.
HOMOGLYPHS = str.maketrans("абвгеёіјкмнорсԁѕтухһԛԝαβεικνορτυχ", "a6breeijkmhopcdstyxhqwabeikvoptux")
FOREIGN = re.compile("[Ͱ-ԯ]")
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
SUBSTITUTED = re.compile("[013457@$]+")
EXCUSED = ("trash can", "trash bin", "clown fish", "idiot proof")


def fold(text: str) -> str:
    """Lower case, look-alikes to Latin letters, and digit substitutions undone where they touch a letter."""
    t = text.lower()
    if FOREIGN.search(t):
        t = t.translate(HOMOGLYPHS)

    def sub(m: re.Match) -> str:
        a, b = m.span()
        if (a and t[a - 1].isalpha()) or (b < len(t) and t[b].isalpha()):
            return "".join(map(DIGITS.__getitem__, m[0]))
        return m[0]

    return SUBSTITUTED.sub(sub, t)


WORD = re.compile(r"[^\W_]+")


@dataclass
class Lexicon:
    weights: dict[str, float]
    excused: tuple[str, ...]
    #: logit = bias + total * log1p(weight found) + density * log1p(100 * weight found / words)
    bias: float
    total: float
    density: float

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for w, x in self.weights.items():
            a.add_word(w, (len(w), x))
        for p in self.excused:
            a.add_word(p, (len(p), None))
        if len(a):
            a.make_automaton()
        return a


def found(folded: str, automaton) -> float:
    """Summed weights of whole-word terms that lie in no exception phrase."""
    if not len(automaton):
        return 0.0
    hits, excused = [], []
    n = len(folded)
    for end, (size, weight) in automaton.iter(folded):
        a, b = end + 1 - size, end + 1
        if (a and folded[a - 1].isalnum()) or (b < n and folded[b].isalnum()):
            continue
        if weight is None:
            excused.append((a, b))
        else:
            hits.append((a, b, weight))
    # of all phrases that begin no later than a term, the one that ends last decides
    excused.sort()
    begins, reach = [x for x, _ in excused], list(accumulate((y for _, y in excused), max))
    total = 0.0
    for a, b, w in hits:
        k = bisect_right(begins, a)
        if not k or reach[k - 1] < b:
            total += w
    return total


def _shape(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1))])


def fit(rows: list[tuple[str, int]], excused: tuple[str, ...] = EXCUSED, least_contexts: int = LEAST_CONTEXTS, least_weight: float = LEAST_WEIGHT) -> Lexicon:
    """A lexicon from (text, label).

    A term's evidence is the number of different neighbourhoods (word before,
    word after) it has in toxic and in other texts, so that a passage copied
    many times counts once. Its weight is the smoothed log odds. Two-word
    phrases that hold a term and stand in other texts as often as in toxic
    ones become exceptions.
    """
    texts = [(WORD.findall(fold(t)), int(y)) for t, y in rows]
    df = (Counter(), Counter())
    for words, y in texts:
        df[y].update(set(words))
    n = [max(1, sum(1 for _, y in texts if y == k)) for k in (0, 1)]
    likely = {w for w, k in df[1].items() if k >= 3 and k / n[1] > 3 * df[0][w] / n[0]}
    around: tuple[dict, dict] = ({}, {})
    for words, y in texts:
        for i, w in enumerate(words):
            if w in likely:
                pair = (words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")
                around[y].setdefault(w, set()).add(pair)
    weights, out = {}, set(excused)
    total = [sum(len(w) for w, y in texts if y == k) + 1 for k in (0, 1)]
    for w in likely:
        bad, good = len(around[1].get(w, ())), len(around[0].get(w, ()))
        odds = math.log((bad + 0.5) / total[1]) - math.log((good + 0.5) / total[0])
        if bad >= least_contexts and odds >= least_weight and bad > 10 * good * total[1] / total[0] + 3 * math.sqrt(good):
            weights[w] = odds
    pairs = (Counter(), Counter())
    for words, y in texts:
        pairs[y].update({f"{a} {b}" for a, b in zip(words, words[1:]) if a in weights or b in weights})
    out |= {p for p, k in pairs[0].items() if k >= 3 and k / n[0] >= pairs[1][p] / n[1]}
    lex = Lexicon(weights, tuple(sorted(out)), 0, 0, 0)
    auto = lex.automaton()
    got = np.array([found(fold(t), auto) for t, _ in rows]) if rows else np.zeros(0)
    x = _shape(got, np.array([len(t.split()) for t, _ in rows], float))
    y = np.array([y for _, y in rows], float)
    coef = np.zeros(3)
    for _ in range(40):  # Newton steps of a ridge logistic fit
        p = 1 / (1 + np.exp(-x @ coef))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.1, 0.1])
        coef -= np.linalg.solve(h, x.T @ (p - y) + coef * [1e-3, 0.1, 0.1])
    lex.bias, lex.total, lex.density = map(float, coef)
    return lex


def score_texts(docs: DataFrame, lex: Lexicon, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs -> kept columns, tox_weight (of terms found) and tox_score (0 to 1) of every whole text.

    Null and empty texts have weight 0 and the score of a text without terms.
    Every row gives one row, repeated rows too; an empty table gives an empty
    one. Columns that are not kept are ignored. Where a kept column has the
    name of a result, the result's name gets an underscore more.
    """
    # a kept text goes to Python once, and is read one at a time there
    rows = docs.select(*kept_as(keep), *([] if "text" in keep else [F.col("text").alias("_text")]))
    at = keep.index("text") if "text" in keep else len(keep)

    def run(batches):
        auto = lex.automaton()
        for batch in batches:
            weight, words = np.zeros(batch.num_rows), np.ones(batch.num_rows)
            for i, t in enumerate(batch.column(at)):
                text = t.as_py()
                weight[i] = found(fold(text), auto) if text else 0.0
                if weight[i]:
                    words[i] = len(text.split())
            score = 1 / (1 + np.exp(-_shape(weight, words) @ np.array([lex.bias, lex.total, lex.density])))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(weight), pa.array(score)], names=[*batch.schema.names[: len(keep)], "tox_weight", "tox_score"])

    out = rows.mapInArrow(run, f"{kept_schema(rows, keep)}tox_weight double, tox_score double")
    return named_back(out, keep, ("tox_weight", "tox_score"))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from at most `sample` labelled documents outside the held-out fold."""
    return fit(labelled_texts(docs, labels, "toxic", 4, 2, sample, SAMPLE_BYTES))


def without_toxic(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns stay, whatever their names."""
    score = unused("tox_score", docs.columns)
    return score_texts(docs, lex, tuple(docs.columns)).where(F.col(f"`{score}`") < THRESHOLD).select(*[F.col(f"`{k}`") for k in docs.columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_texts(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"))
