"""Periodic runs of words: aligned blocks searched across their text seed exact extensions."""

from __future__ import annotations

from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.samples import kept_as, kept_schema, named_back
from brindle.session import table

#: Least length of a run in words; a run also holds its period twice.
LEAST = 12
#: A word is spelled as digits of this base for the automaton, so that no node has more children.
BASE = 64
WORD_GAP = r"[\x20\x09-\x0D]+"


def scales(n: int, least: int = LEAST) -> list[tuple[int, np.ndarray]]:
    """(block size, periods it is searched for) of a text of n words.

    The words of a run that recur one period later are at least
    max(least - period, period) in a row. Among 2s - 1 words in a row a whole
    aligned block of s lies, so a period takes the largest power of two with
    2s - 1 of at most that many.
    """
    out: dict[int, list[int]] = {}
    edge = min(n // 2, max(least, 4))
    for q in range(1, edge + 1):
        out.setdefault(_block_of(max(least - q, q)), []).append(q)
    got = {s: np.array(q) for s, q in out.items()}
    s = _block_of(edge + 1)
    while 2 * s - 1 <= n // 2:
        far = np.arange(max(2 * s - 1, edge + 1), min(4 * s - 2, n // 2) + 1)
        if len(far):
            got[s] = np.union1d(got[s], far) if s in got else far
        s *= 2
    return sorted(got.items())


def _block_of(recurring: int) -> int:
    return 1 << (((recurring + 1) // 2).bit_length() - 1)


def _spelling(n_ids: int) -> int:
    """Digits that a word's number takes."""
    k = 1
    while BASE**k < n_ids:
        k += 1
    return k


class Blocks:
    """The aligned blocks of one text of word numbers, and where their words occur in it.

    Words that stand once have numbers below 0 and are part of no block that
    recurs. A block is a key only if both its halves recur side by side, as a block that
    recurs takes its halves along; most texts have no block left after a scale
    or two.
    """

    def __init__(self, ids: np.ndarray):
        ids = np.maximum(ids, 0)
        self.ids = ids
        self.digits = _spelling(int(ids.max()) + 1)
        spelled = np.stack([(ids // BASE ** (self.digits - 1 - k)) % BASE + BASE * k for k in range(self.digits)], axis=1)
        self.text = tuple(spelled.ravel().tolist())
        self.size, self.recurs = 0, ids > 0

    def occurrences(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Content number of each aligned block of s words (-1: none), and of the block content that starts at each word (-1: none)."""
        at, n = np.full(len(self.ids), -1, np.int64), len(self.ids) // s
        content = np.full(n, -1, np.int64)
        grow = s // self.size if self.size else s
        alive = self.recurs[: n * grow].reshape(n, grow).all(axis=1)
        self.size, self.recurs = s, np.zeros(n, bool)
        if not alive.any():
            return content, at
        auto, k = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), self.digits
        numbers: dict[tuple, int] = {}
        for j in np.flatnonzero(alive).tolist():
            key = self.text[j * s * k : (j + 1) * s * k]
            c = numbers.get(key)
            if c is None:
                c = numbers[key] = len(numbers)
                auto.add_word(key, c)
            content[j] = c
        auto.make_automaton()
        found = np.fromiter((x for pair in auto.iter(self.text) for x in pair), np.int64)
        ends, which = found[::2], found[1::2]
        at[(ends + 1) // k - s] = which
        many = np.bincount(which, minlength=len(numbers))
        self.recurs[alive] = many[content[alive]] > 1
        return content, at


def _seeds(content: np.ndarray, at: np.ndarray, s: int, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of a block, distance of a later occurrence of it) for all distances among `periods`, by distance, then start."""
    where = np.flatnonzero(at >= 0)
    lo, hi = int(periods[0]), int(periods[-1])
    starts, gaps = [], []
    wanted = np.zeros(hi + 1, bool)
    wanted[periods] = True
    for back in range((hi - lo) // s + 2):
        j = (where - lo) // s - back
        gap = where - j * s
        ok = (j >= 0) & (j < len(content)) & (gap >= lo) & (gap <= hi)
        t, j, gap = where[ok], j[ok], gap[ok]
        ok = wanted[gap] & (content[j] == at[t])
        starts.append(j[ok] * s)
        gaps.append(gap[ok])
    start, gap = np.concatenate(starts), np.concatenate(gaps)
    order = np.lexsort((start, gap))
    return start[order], gap[order]


def _reach(ids: np.ndarray, a: int, d: int) -> int:
    """First t >= a with ids[t] != ids[t + d], or where the text ends."""
    end, step = len(ids) - d, 32
    while a < end:
        b = min(a + step, end)
        differs = ids[a:b] != ids[a + d : b + d]
        k = int(differs.argmax())
        if differs[k]:
            return a + k
        a, step = b, step * 4
    return end


def _reach_back(ids: np.ndarray, a: int, d: int) -> int:
    """Least t such that ids[t:a] recur d later."""
    step = 32
    while a > 0:
        b = max(a - step, 0)
        differs = (ids[b:a] != ids[b + d : a + d])[::-1]
        k = int(differs.argmax())
        if differs[k]:
            return a - k
        a, step = b, step * 4
    return 0


def runs_of(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs of a sequence of word numbers (below 0: a word that stands once) as rows (start, length, period), by start, then period.

    A run is a longest stretch with smallest period q, at least `least` words
    and 2q long. An aligned block inside it recurs q later (see scales), so an
    occurrence of a block at a distance that its scale stands for is extended
    both ways as far as words a distance apart are alike. A stretch that is
    found with several periods is a run of the least. Seeds inside a run of a
    period shorter than their distance and no longer than their block extend to
    that very run and are skipped.
    """
    found: dict[tuple[int, int], int] = {}
    if len(ids) >= least and (ids > 0).any():
        blocks = Blocks(ids)
        for s, periods in scales(len(ids), least):
            content, at = blocks.occurrences(s)
            if not blocks.recurs.any():
                break  # a larger block would recur with its parts
            start, gap = _seeds(content, at, s, periods)
            if len(start) and found:
                known = np.array(sorted((a, b) for (a, b), q in found.items() if q <= s and q < gap[0])).reshape(-1, 2)
                if len(known):
                    upto = np.maximum.accumulate(known[:, 1])
                    k = np.searchsorted(known[:, 0], start, "right")
                    outside = (k == 0) | (upto[np.maximum(k - 1, 0)] < start + gap + s)
                    start, gap = start[outside], gap[outside]
            k = 0
            while k < len(start):
                a, d = int(start[k]), int(gap[k])
                first, stop = _reach_back(ids, a, d), _reach(ids, a + s, d)
                end = stop + d
                if end - first >= max(least, 2 * d):
                    found[first, end] = min(d, found.get((first, end), d))
                same = int(np.searchsorted(gap, d, "right"))
                k += int(np.searchsorted(start[k:same], stop, "left"))
    rows = sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))
    return np.array(rows, np.int64).reshape(-1, 3)


def numbered(words: list[bytes]) -> np.ndarray:
    """Word numbers of a text, from 1; each word that stands once has a number of its own below 0."""
    many = Counter(words)
    number = {w: k if n > 1 else -k for k, (w, n) in enumerate(sorted(many.items(), key=lambda x: -x[1]), 1)}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def without_repeats(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """words without those that a run holds behind its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", least: int = LEAST) -> DataFrame:
    """docs -> kept columns, n_words, runs (array of start, length, period; words count from 0) and collapsed (the text without repeats, words joined by one blank).

    Words are `[^\\x20\\x09-\\x0D]+`. Every row gives one row, repeated rows
    too; nothing is shuffled and nothing leaves its row, so a lost executor
    repeats its own rows only. Null and empty texts have no word, no run and
    an empty collapsed text. Runs may overlap; several may start at one word.
    A very long text is worked through whole in one task: memory is a fixed
    multiple of its words. Columns that are not kept are ignored; where a kept
    column has a result's name, the result's name gets an underscore more. An
    empty table gives an empty table.
    """
    rows = docs.select(*kept_as(keep), F.col(f"`{text_col}`").cast("binary").alias("_raw"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            count, offs, parts, texts = [], [0], [], []
            for raw_text in batch.column("_raw").to_pylist():
                words = (raw_text or b"").split()
                got = runs_of(numbered(words), least) if len(words) >= least else np.zeros((0, 3), np.int64)
                count.append(len(words))
                parts.append(got)
                offs.append(offs[-1] + len(got))
                texts.append(b" ".join(without_repeats(words, got)))
            flat = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
            fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), fields).cast(run_type)
            cols = [*batch.columns[:-1], pa.array(count, pa.int64()), lists, pa.array(texts, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"])

    out = rows.mapInArrow(run, f"{kept_schema(rows, keep)}n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return named_back(out, keep, ("n_words", "runs", "collapsed"))


def planted(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, text in which every tenth document (by crc32 of its id) goes round in circles from some word on; a null id is never among them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def circled(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(F.floor(h / 10), n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(F.floor(h / 10), F.lit(8))))).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i)))

    words = F.filter(F.split(F.col("text"), WORD_GAP), lambda x: x != "")
    text = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(circled(w), " ")).otherwise("")).getItem(0)
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(planted(table(spark, sf_dir, "documents")))
    # greatest length, then least start, then least period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_b", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_b.start")).alias("start"),
        F.col("_b.length").alias("length"),
        (-F.col("_b.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("_b.length") / -F.col("_b.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
