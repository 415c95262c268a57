"""Quality: a linear-chain conditional random field over a document's lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import crf
from brindle.llm.buffers import byte_slices, segment_sums, words_of
from brindle.llm.samples import fold_of, kept_as, kept_schema, labelled_texts, named_back
from brindle.session import table

#: Labelled documents, and bytes of their texts, that a field is fitted on.
SAMPLE, SAMPLE_BYTES = 4000, 8 << 20
#: Thresholds at which each line feature switches an indicator on.
STEPS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7)

_B = np.arange(256)
UPPER = (_B >= 65) & (_B <= 90)
LOWER = (_B >= 97) & (_B <= 122)
DIGIT = (_B >= 48) & (_B <= 57)
SPACE = np.isin(_B, [32, 9, 10, 11, 12, 13])
WIDE = _B >= 128
STOP = np.isin(_B, list(b".,;:?'\"()-"))
MARK = ~(UPPER | LOWER | DIGIT | SPACE | WIDE | STOP)
CLASSES = np.stack([UPPER, DIGIT, STOP, MARK, SPACE], axis=1).astype(np.float32)
HASH = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def line_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of documents -> (features, line bytes, first line of each document, its number of lines).

    Empty lines are no lines. Features of a line: shares of capitals, digits,
    stops, other marks and blanks among its bytes, share of words that repeat
    the word before or one met up to 16 words before, share of words ending in
    a mark, word length and line length; each as steps, with the same for the
    line before and the line after.
    """
    n = len(buf)
    nl = np.flatnonzero(buf == 10)
    # a line starts at a document's start or after a newline, and ends before the next newline or document's end
    starts = np.unique(np.concatenate((offs[:-1], nl + 1)))
    starts = starts[starts < n]
    stops = np.append(starts[1:], n)
    size = stops - starts
    newline = np.zeros(n, bool)
    newline[nl] = True
    size = size - (newline[stops - 1] if n else 0)
    keep = size > 0
    starts, stops, size = starts[keep], stops[keep], size[keep]
    m = len(starts)
    doc = np.searchsorted(offs, starts, "right") - 1
    count = np.bincount(doc, minlength=len(offs) - 1)
    first = np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64)
    if not m:
        return np.zeros((0, 1 + 9 * 3 * len(STEPS) + 3), np.float32), size, first, count
    base = np.empty((m, 9))
    for k in range(5):
        sums = np.concatenate(([0], np.cumsum(CLASSES[:, k][buf], dtype=np.float64)))
        base[:, k] = (sums[starts + size] - sums[starts]) / size
    a, b = words_of(buf, offs)
    power = HASH[buf]
    mixed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(power, dtype=np.uint64)))
    # a word's name: its byte table sum, its length and its first and last bytes
    name = (mixed[b] - mixed[a]) ^ ((b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (power[a] >> np.uint64(3)) ^ (power[b - 1] >> np.uint64(7))
    line_of = np.searchsorted(starts, a, "right") - 1
    again = np.zeros(len(a), bool)
    for back in range(1, 17):
        if len(a) > back:
            again[back:] |= (name[back:] == name[:-back]) & (line_of[back:] == line_of[:-back]) & ((b - a)[back:] > 3)
    next_to = np.zeros(len(a), bool)
    if len(a) > 1:
        next_to[1:] = (name[1:] == name[:-1]) & (line_of[1:] == line_of[:-1])
    n_words = np.maximum(1, np.bincount(line_of, minlength=m))
    base[:, 5] = np.bincount(line_of, again | next_to, minlength=m) / n_words
    base[:, 6] = np.bincount(line_of, MARK[buf[b - 1]], minlength=m) / n_words
    base[:, 7] = np.minimum(1, size / n_words / 20)
    base[:, 8] = np.minimum(1, np.log1p(size) / 10)
    steps = (base[:, :, None] > np.array(STEPS)).reshape(m, -1).astype(np.float32)
    before, after = np.zeros_like(steps), np.zeros_like(steps)
    inner = doc[1:] == doc[:-1]
    before[1:][inner] = steps[:-1][inner]
    after[:-1][inner] = steps[1:][inner]
    edge = np.ones((m, 3), np.float32)
    edge[1:, 1] = ~inner
    edge[:-1, 2] = ~inner
    return np.hstack([edge[:, :1], steps, before, after, edge]), size, first, count


@dataclass
class LineField:
    weights: np.ndarray
    trans: np.ndarray
    first: np.ndarray
    slope: float
    bias: float
    prior: float

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Quality of each document: marginals of good lines weighted by length, calibrated."""
        x, size, first, count = line_features(buf, offs)
        good = crf.forward_backward(x @ self.weights.astype(x.dtype), first, count, self.trans, self.first)[:, 1]
        raw, has = aggregate(good, size, first, count)
        return np.where(has, 1 / (1 + np.exp(-(self.slope * raw + self.bias))), self.prior)


def aggregate(good: np.ndarray, size: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    offs = np.append(first, first[-1] + count[-1]) if len(first) else np.zeros(1, np.int64)
    total = segment_sums(size.astype(float), offs)
    return np.divide(segment_sums(good * size, offs), total, out=np.zeros(len(total)), where=total > 0), total > 0


def fit(rows: list[tuple[str, int]], rounds: int = 150) -> LineField:
    """A field from (text, label): each line carries its document's label."""
    raw = [t.encode("utf-8", "surrogatepass") for t, _ in rows]
    y = np.array([y for _, y in rows], int)
    offs = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    x, size, first, count = line_features(np.frombuffer(b"".join(raw), np.uint8), offs)
    prior = float(y.mean()) if len(y) else 0.5
    L = 2
    if not len(x) or len(set(y.tolist())) < 2:
        return LineField(np.zeros((x.shape[1], L)), np.zeros((L, L)), np.zeros(L), 0.0, float(np.log((prior + 1e-3) / (1 - prior + 1e-3))), prior)
    has = count > 0
    w, trans, start = crf.fit_dense(x, np.repeat(y, count), first[has], count[has], L, rounds)
    raw_score, ok = aggregate(crf.forward_backward(x @ w.astype(x.dtype), first, count, trans, start)[:, 1], size, first, count)
    z = np.column_stack([raw_score[ok], np.ones(ok.sum())])
    t = y[ok]
    c = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ c))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.eye(2) * 1e-3
        c -= np.linalg.solve(h, z.T @ (p - t) + 1e-3 * c)
    return LineField(w, trans, start, float(c[0]), float(c[1]), prior)


def score_quality(docs: DataFrame, field: LineField, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs -> kept columns and score (0 to 1, higher is better) of every whole text.

    Null texts, empty texts and texts of newlines have no line and score the
    share of good documents in the fitting sample. Every row gives one row,
    repeated rows too; an empty table gives an empty one. Columns that are not
    kept are ignored, whatever their names; if one is kept that is named score,
    the result is score_.
    """
    rows = docs.select(*kept_as(keep), F.col("text").alias("_text"))

    def run(batches):
        for batch in batches:
            out = [field.score(buf, offs) for _, _, buf, offs in byte_slices(batch, "_text")]
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*batch.schema.names[:-1], "score"])

    return named_back(rows.mapInArrow(run, f"{kept_schema(rows, keep)}score double"), keep, ("score",))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineField:
    """A field from at most `sample` labelled documents outside the held-out fold."""
    return fit(labelled_texts(docs, labels, "quality", 5, 0, sample, SAMPLE_BYTES))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
