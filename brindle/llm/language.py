"""Language of words by a linear-chain conditional random field, and of documents by its marginals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import crf
from brindle.llm.buffers import byte_slices, segment_sums
from brindle.llm.samples import bounded, fold_of, kept_as, kept_schema, named_back, thinned
from brindle.session import table

#: Documents, and bytes of their texts, that a field is fitted on.
SAMPLE, SAMPLE_BYTES = 1500, 8 << 20
#: Words at each end of a text that speak for its frame: a passage in another language is taken to lie inside a text.
EDGE_WORDS = 4
TABLE_BITS = 16
UNKNOWN = "und"

_B = np.arange(256)
ASCII_LETTER = ((_B | 32) >= 97) & ((_B | 32) <= 122) & (_B < 128)
IN_WORD = ASCII_LETTER | (_B >= 128)
FOLDED = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
MIX = np.random.default_rng(11).integers(1, 1 << 63, (4, 256), dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(64 - TABLE_BITS)


@dataclass
class Words:
    """Runs of letters of some documents: a chain for each line that has any."""

    size: np.ndarray  # bytes of each word
    doc: np.ndarray  # document of each word
    first: np.ndarray  # first word of each chain
    count: np.ndarray  # words of each chain
    names: list[np.ndarray]  # a table row of each word for each affix, and for the whole word
    grams: np.ndarray  # a table row of each byte trigram
    gram_offs: np.ndarray  # trigrams of each word


def words_in(buf: np.ndarray, offs: np.ndarray) -> Words:
    """Words (runs of letters, or of bytes above ASCII) with the rows of their affix, trigram and lexicon features."""
    b = FOLDED[buf]
    if len(b) > 1:  # capital letters of Latin-1 in UTF-8
        wide = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)) + 1
        b[wide] += 0x20
    inside = IN_WORD[b]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(b))]
    start[cut] = inside[cut]
    stop[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    size = e - s
    doc = np.searchsorted(offs, s, "right") - 1
    line = np.concatenate(([0], np.cumsum(b == 10)))[s] if len(b) else s
    new = np.ones(len(s), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(s)))
    # affixes of one to three bytes at either end; shorter words end in a blank
    at = [np.where(size > k, b[np.minimum(s + k, len(b) - 1)], 32) for k in range(3)] if len(s) else [np.zeros(0, np.uint8)] * 3
    back = [np.where(size > k, b[np.maximum(e - 1 - k, 0)], 32) for k in range(3)] if len(s) else [np.zeros(0, np.uint8)] * 3

    def row(salt: int, *parts) -> np.ndarray:
        h = np.full(len(s), np.uint64(salt * 2654435761 + 1))
        for k, x in enumerate(parts):
            h = (h ^ MIX[k][x]) * STEP
        return (h >> SHIFT).astype(np.int32)

    # tri[p]: bytes p, p+1, p+2; a sum of a word's place-dependent trigrams names the whole word
    pad = np.concatenate((b, np.full(2, 32, np.uint8)))
    tri = (MIX[0][pad[:-2]] ^ MIX[1][pad[1:-1]] ^ MIX[2][pad[2:]]) * STEP
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tri, dtype=np.uint64)))
    whole = ((total[np.maximum(e - 2, s)] - total[s]) ^ MIX[3][np.minimum(size, 255)] ^ MIX[2][at[0]] ^ MIX[1][back[0]] ^ (MIX[0][back[1]] >> np.uint64(1))) * STEP
    names = [row(1, at[0], at[1]), row(2, *at), row(3, back[0], back[1]), row(4, *back), (whole >> SHIFT).astype(np.int32)]
    n_grams = np.maximum(size - 2, 0)
    gram_offs = np.concatenate(([0], np.cumsum(n_grams))).astype(np.int64)
    if gram_offs[-1]:
        keep = np.zeros(len(b) + 1, np.int8)
        long = n_grams > 0
        np.add.at(keep, s[long], 1)
        np.add.at(keep, e[long] - 2, -1)
        grams = (tri[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)] >> SHIFT).astype(np.int32)
    else:
        grams = np.zeros(0, np.int32)
    return Words(size, doc, first, count, names, grams, gram_offs)


@dataclass
class WordField:
    langs: list[str]
    affix: np.ndarray  # (5, rows, L)
    gram: np.ndarray  # (rows, L)
    trans: np.ndarray
    first: np.ndarray
    #: how a document's share, opening and close weigh in its language
    frame: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        out = np.zeros((len(w.size), len(self.langs)))
        for k, rows in enumerate(w.names):
            out += self.affix[k][rows]
        n = np.diff(w.gram_offs)
        return out + segment_sums(self.gram[w.grams], w.gram_offs) / np.sqrt(np.maximum(n, 1))[:, None]

    def label(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each language for each document; its letters."""
        parts, letters = self.parts(buf, offs)
        z = parts @ self.frame
        z = np.exp(z - z.max(axis=1, keepdims=True)) if z.shape[1] else z
        return np.divide(z, z.sum(axis=1, keepdims=True), out=np.zeros_like(z), where=letters[:, None] > 0), letters

    def parts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, L, 3): each language's share of the letters, of the first words and of the last words; letters.

        A passage in another language lies inside a document, so its opening
        and close tell the document's own language.
        """
        w = words_in(buf, offs)
        p = crf.forward_backward(self.emissions(w), w.first, w.count, self.trans, self.first)
        docs = len(offs) - 1
        per = np.searchsorted(w.doc, np.arange(docs + 1))
        mass = segment_sums(p * w.size[:, None], per)
        letters = segment_sums(w.size.astype(float), per)
        share = np.divide(mass, letters[:, None], out=np.zeros_like(mass), where=letters[:, None] > 0)
        n = np.diff(per)
        head, tail = np.zeros_like(share), np.zeros_like(share)
        has = n > 0
        for k in range(EDGE_WORDS):
            head[has] += p[np.minimum(per[:-1] + k, per[1:] - 1)[has]] / EDGE_WORDS
            tail[has] += p[np.maximum(per[1:] - 1 - k, per[:-1])[has]] / EDGE_WORDS
        return np.stack([share, head, tail], axis=2), letters


def _fit_frame(parts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Softmax regression on the three shares, alike for all languages."""
    c = np.full(3, 2.0)
    gold = parts[np.arange(len(y)), y]
    for _ in range(300):
        z = parts @ c
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        c += 2.0 * ((gold - np.einsum("nl,nlk->nk", q, parts)).mean(axis=0) - 1e-3 * c)
    return c


def fit(rows: list[tuple[str, str]], epochs: int = 4, per_step: int = 40, lr: float = 0.3) -> WordField:
    """A field from (text, language): each word carries its document's language. AdaGrad over steps of some documents."""
    langs = sorted({y for _, y in rows})
    L, R = len(langs), 1 << TABLE_BITS
    code = {y: k for k, y in enumerate(langs)}
    f = WordField(langs, np.zeros((5, R, L), np.float32), np.zeros((R, L), np.float32), np.zeros((L, L)), np.zeros(L), np.array([5.0, 1.0, 1.0]))
    seen = [np.full(x.shape, 1e-2) for x in (f.affix, f.gram, f.trans, f.first)]

    def step(param, acc, grad):
        acc += grad * grad
        param -= lr * grad / np.sqrt(acc)

    order = np.random.default_rng(5).permutation(len(rows))
    for _ in range(epochs if L > 1 else 0):
        for k in range(0, len(rows), per_step):
            part = [rows[i] for i in order[k : k + per_step]]
            raw = [t.encode("utf-8", "surrogatepass") for t, _ in part]
            offs = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
            w = words_in(np.frombuffer(b"".join(raw), np.uint8), offs)
            if not len(w.size):
                continue
            y = np.array([code[c] for _, c in part])[w.doc]
            gold = np.zeros((len(y), L))
            gold[np.arange(len(y)), y] = 1
            p, xi, _, pf = crf.forward_backward(f.emissions(w), w.first, w.count, f.trans, f.first, pairs=True)
            g = p - gold
            inner = np.ones(len(y), bool)
            inner[w.first + w.count - 1] = False
            i = np.flatnonzero(inner)
            for j, names in enumerate(w.names):
                u, at = np.unique(names, return_inverse=True)
                grad = np.stack([np.bincount(at, g[:, c]) for c in range(L)], axis=1)
                _sparse(f.affix[j], seen[0][j], u, grad, lr)
            n = np.diff(w.gram_offs)
            u, at = np.unique(w.grams, return_inverse=True)
            if len(u):
                gg = np.repeat(g / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0)
                _sparse(f.gram, seen[1], u, np.stack([np.bincount(at, gg[:, c]) for c in range(L)], axis=1), lr)
            m = len(y)
            step(f.trans, seen[2], (xi - gold[i].T @ gold[i + 1]) / m)
            step(f.first, seen[3], (pf - gold[w.first].sum(axis=0)) / m)
    if L > 1:
        parts = []
        for k in range(0, len(rows), per_step):
            raw = [t.encode("utf-8", "surrogatepass") for t, _ in rows[k : k + per_step]]
            offs = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
            parts.append(f.parts(np.frombuffer(b"".join(raw), np.uint8), offs)[0])
        f.frame = _fit_frame(np.concatenate(parts), np.array([code[y] for _, y in rows]))
    return f


def _sparse(param, acc, rows, grad, lr):
    acc[rows] += grad * grad
    param[rows] -= (lr * grad / np.sqrt(acc[rows])).astype(np.float32)


def identify(docs: DataFrame, field: WordField, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs -> kept columns, lang_pred, score (its probability) of every whole text.

    Null texts and texts without a letter are `und` with score 0. Every row
    gives one row, repeated rows and rows without an id too; an empty table
    gives an empty one. Other columns are ignored; a kept column may have any
    name, and a result of that name gets an underscore more.
    """
    rows = docs.select(*kept_as(keep), F.col("text").alias("_text"))

    def run(batches):
        names = np.array([*field.langs, UNKNOWN], object)
        for batch in batches:
            pred, score = [], []
            texts = batch.column("_text")
            for a, b, buf, offs in byte_slices(batch, "_text"):
                share, letters = field.label(buf, offs)
                has = letters > 0
                ascii_letters = segment_sums(ASCII_LETTER[buf].astype(np.int64), offs) > 0
                for i in np.flatnonzero(has & ~ascii_letters):
                    has[i] = any(ch.isalpha() for ch in texts[a + int(i)].as_py())
                best = share.argmax(axis=1) if share.shape[1] else np.full(b - a, -1)
                if not share.shape[1]:
                    has[:] = False
                pred.append(np.where(has, best, len(field.langs)))
                score.append(np.where(has, share.max(axis=1) if share.shape[1] else 0.0, 0.0))
            pred = np.concatenate(pred) if pred else np.zeros(0, int)
            score = np.concatenate(score) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[pred].tolist(), pa.string()), pa.array(np.clip(score, 0, 1))], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    out = rows.mapInArrow(run, f"{kept_schema(rows, keep)}lang_pred string, score double")
    return named_back(out, keep, ("lang_pred", "score"))


def fitted(docs: DataFrame, sample: int = SAMPLE) -> WordField:
    """A field from at most `sample` documents with a language, outside the held-out fold."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), 4) != 2))
    rows = bounded(thinned(known, "doc_id", 2 * sample), sample, SAMPLE_BYTES)
    return fit([(r.text, r.lang) for r in rows])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fitted(docs))
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
