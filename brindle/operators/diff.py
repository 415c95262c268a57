"""Differences of texts: words that stand once on both sides and keep their order are anchors, gaps between them are read again."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KEPT, GONE, CAME = "=", "-", "+"


def _rising(values: list[int]) -> list[int]:
    """Places of a longest increasing run of different values, by piles: n log n."""
    tops: list[int] = []  # least last value of a run of each length
    ends: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _anchors(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and y of what stands once in both and keeps its order, as much of it as can."""

    def once(v):
        u, at, n = np.unique(v, return_index=True, return_counts=True)
        return u[n == 1], at[n == 1]

    (u, i), (v, j) = once(x), once(y)
    _, p, q = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    order = np.argsort(i[p])
    i, j = i[p][order], j[q][order]
    keep = _rising(j.tolist())
    return i[keep], j[keep]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (in a, in b) of what stays, rising on both sides.

    Common beginnings and ends stay; between them anchors stay, and each gap
    between anchors is read in the same way, where words that are frequent in
    the whole may stand once. A gap without anchors is exchanged whole.
    """
    number: dict[str, int] = {}
    x, y = (np.fromiter((number.setdefault(w, len(number)) for w in side), np.int64, len(side)) for side in (a, b))
    out, gaps = [], [(0, len(x), 0, len(y))]
    while gaps:
        i, j, k, m = gaps.pop()
        for step in (1, -1):
            n = min(j - i, m - k)
            same = x[i:j][::step][:n] == y[k:m][::step][:n]
            n = n if same.all() else int(same.argmin())
            out += [(i + t, k + t) for t in range(n)] if step == 1 else [(j - 1 - t, m - 1 - t) for t in range(n)]
            i, k, j, m = (i + n, k + n, j, m) if step == 1 else (i, k, j - n, m - n)
        if i == j or k == m:
            continue
        p, q = _anchors(x[i:j], y[k:m])
        if len(p):
            out += zip((i + p).tolist(), (k + q).tolist())
            gaps += zip([i, *(i + p + 1)], [*(i + p), j], [k, *(k + q + 1)], [*(k + q), m])
    return sorted(out)


def edits(a: list[str], b: list[str]) -> list[tuple[str, list[str]]]:
    """(KEPT, GONE or CAME, words) of both sides in one, what is gone before what came in its place."""
    out, i, k = [], 0, 0

    def put(kind, words):
        if words and out and out[-1][0] == kind:
            out[-1][1].extend(words)
        elif words:
            out.append((kind, list(words)))

    for p, q in [*aligned(a, b), (len(a), len(b))]:
        put(GONE, a[i:p])
        put(CAME, b[k:q])
        put(KEPT, a[p : p + 1])
        i, k = p + 1, q + 1
    return out


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text or "")


def word_edits(old: Column, new: Column) -> Column:
    """Array of (kind, text) that turns the words of old into those of new; null counts as empty. One pair of texts is held at a time."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": t, "text": " ".join(w)} for t, w in edits(_words(x), _words(y))] for x, y in zip(a, b)], dtype=object)

    return F.pandas_udf(run, "array<struct<kind:string,text:string>>")(old, new)


def side(found: Column, kind: str) -> Column:
    """One side of word_edits, words joined by a blank: what is kept and what is of `kind`."""
    return F.array_join(F.transform(F.filter(found, lambda e: e["kind"].isin(KEPT, kind)), lambda e: e["text"]), " ")


def words_of(found: Column, kind: str) -> Column:
    """Number of words of a kind."""
    return F.aggregate(F.filter(found, lambda e: e["kind"] == kind), F.lit(0).cast("long"), lambda n, e: n + F.size(F.split(e["text"], " ")))


def marked(found: Column) -> Column:
    """word_edits as one text: words that went in del, those that came in ins, all escaped."""
    text = lambda e: F.replace(F.replace(F.replace(F.replace(F.replace(e["text"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    tag = lambda e, name: F.concat(F.lit(f"<{name}>"), text(e), F.lit(f"</{name}>"))
    return F.array_join(F.transform(found, lambda e: F.when(e["kind"] == GONE, tag(e, "del")).when(e["kind"] == CAME, tag(e, "ins")).otherwise(text(e))), " ")


def word_diff(old: Column, new: Column) -> Column:
    """Words of both texts in one, marked."""
    return marked(word_edits(old, new))


def _hunks(a: list[str], b: list[str], context: int) -> str:
    """Lines of both sides with a sign in front, in stretches of what changed and `context` lines around it."""
    lines, i, k = [], 1, 1
    for kind, words in edits(a, b):
        for w in words:
            lines.append((kind, w, i, k))
            i += kind != CAME
            k += kind != GONE
    near: set[int] = set()
    for t in (t for t, x in enumerate(lines) if x[0] != KEPT):
        near.update(range(max(0, t - context), min(len(lines), t + context + 1)))
    out, group = [], []
    for t in [*sorted(near), None]:
        if group and (t is None or t != group[-1] + 1):
            part = [lines[g] for g in group]
            n, m = sum(x[0] != CAME for x in part), sum(x[0] != GONE for x in part)
            out.append(f"@@ -{part[0][2]},{n} +{part[0][3]},{m} @@")
            out += [{KEPT: " "}.get(x[0], x[0]) + x[1] for x in part]
            group = []
        group.append(t)
    return "\n".join(out)


def line_diff(old: Column, new: Column, context: int = 1) -> Column:
    """Stretches of changed lines with their places and `context` lines around; empty if the texts are equal. Null counts as empty."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_hunks((x or "").split("\n"), (y or "").split("\n"), context) for x, y in zip(a, b)])

    return F.pandas_udf(run, "string")(old, new)
