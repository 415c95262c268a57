"""Sizes, source sizes and targets of a mix, held to a plain count and to the resharing itself."""

from __future__ import annotations

import random
import re
from fractions import Fraction

import pytest

from brindle.llm.mixing import MOST_COPIES, WEIGHTS, mix_sources

BLANK = ["", " ", "\n\t ", "\x0b\x0c\r", "   "]


def shared(sizes: dict) -> dict:
    """Targets by sharing what is over again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    target, left, still = dict.fromkeys(order, Fraction(0)), Fraction(sum(sizes.values())), set(order)
    while left > 0 and still:
        each, left = left / sum(weight[s] for s in still), Fraction(0)
        for s in list(still):
            target[s] += each * weight[s]
            if target[s] >= MOST_COPIES * sizes[s]:
                left += target[s] - MOST_COPIES * sizes[s]
                target[s] = Fraction(MOST_COPIES * sizes[s])
                still.discard(s)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_sizes_and_targets_of_odd_rows(spark, seed):
    draw = random.Random(seed)
    names = [None, "", " ", "a", "B", "é", "￮", "\U0001f600", "web"]
    words = ["one", "two three", " ", "\x00", "\x1f", "\x85", "é", "\U0001f600"]
    text = lambda: draw.choice([None, *BLANK, draw.choice(BLANK).join(draw.choices(words, k=draw.randrange(1, 40)))])
    rows = [(i, text(), draw.choice(names)) for i in range(300)] + [(None, "  ", "only blanks"), (None, "  ", "only blanks")]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    whole = dict.fromkeys({s for _, _, s in rows}, 0)
    for _, t, s in rows:
        whole[s] += size(t)
    target = shared(whole)
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r._row.doc_id is None, r._row.doc_id or 0, r.size, r.source_size) for r in got) == sorted((i is None, i or 0, size(t), whole[s]) for i, t, s in rows)
    for r in got:
        assert r.target == pytest.approx(float(target[r._row.source]), rel=1e-12, abs=1e-9)
    assert all(r.copies * r.size == 0 for r in got if r._row.source == "only blanks")
