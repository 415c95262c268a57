"""SimHash near-duplicates through an inverted index of byte positions with count filtering."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.dedup import components as connected_components
from brindle.session import table, written

BYTES = 8
SLAB = 1 << 16
#: Fingerprints of a block that are tallied against another block at a time.
TALLY = 256


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; 0 for a text without words.

    Shingles are hashed a slab at a time, so memory does not grow with the text
    by more than its words.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    stops = ends[width - 1 :] if len(words) >= width else ends[-1:]
    starts = starts[:n]
    ones = np.zeros(64, np.int64)
    for k in range(0, n, SLAB):
        a, b = starts[k : k + SLAB].tolist(), stops[k : k + SLAB].tolist()
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, map(slice, a, b)), repeat(seed)), np.uint64, len(a))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", width: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs -> the kept columns and fp, a signed long of the same 64 bits."""
    rows = docs.select(*keep, F.col(text_col).alias("_text"))

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width) for t in batch.column("_text").to_pylist()), np.uint64, batch.num_rows)
            cols = [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    kept = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"{kept}, fp long")


def _masks(most_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions that must all match; two fingerprints within most_bits share one at least."""
    return list(combinations(range(BYTES), BYTES - most_bits))


def index_keys(fp: Column, most_bits: int) -> Column:
    """The inverted-index keys of a fingerprint: each is a set of positions with the bytes found there."""
    keys = []
    for k, at in enumerate(_masks(most_bits)):
        mask = sum(0xFF << (8 * i) for i in at)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(k).cast("byte").alias("k"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("bytes")))
    return F.explode(F.array(*keys))


def _link_bucket(fps: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside one posting list of distinct fingerprints.

    The list is cut into blocks by the value of its first free byte. Two blocks
    whose values differ in more than most_bits bits hold no link; of all others
    every pair has its shared positional bytes tallied, and pairs with the
    guaranteed minimum are verified bit by bit. With two free bytes a block has
    256 fingerprints at most and 36 neighbours, so a task tallies no more than
    that for each fingerprint.
    """
    n = len(fps)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out: list[tuple[int, int]] = []
    free = int(np.bitwise_or.reduce(fps ^ fps[0]))
    byte = next((8 * k for k in range(BYTES) if free >> 8 * k & 0xFF), 0)
    value = (fps >> np.uint64(byte)).astype(np.uint8)
    order = np.argsort(value, kind="stable")
    values, at = np.unique(value[order], return_index=True)
    blocks = np.split(order, at[1:])
    for x in range(len(values)):
        for y in np.flatnonzero(np.bitwise_count(values[x:] ^ values[x]) <= most_bits) + x:
            for k in range(0, len(blocks[x]), TALLY):
                a, b = blocks[x][k : k + TALLY], blocks[y]
                diff = fps[a][:, None] ^ fps[b][None, :]
                shared = (diff.view(np.uint8).reshape(len(a), len(b), BYTES) == 0).sum(axis=2)
                i, j = np.nonzero((shared >= BYTES - most_bits) & (np.bitwise_count(diff) <= most_bits) & (diff != 0))
                for p, q in zip(a[i].tolist(), b[j].tolist()):
                    u, v = find(p), find(q)
                    if u != v:
                        root[max(u, v)] = min(u, v)
                        out.append((int(fps[p]), int(fps[q])))
    return out


def fingerprint_links(fps: DataFrame, most_bits: int = 2) -> DataFrame:
    """Distinct fps(fp) -> edges(a, b) that connect exactly what links at most_bits or fewer differing bits connect.

    A posting list holds the fingerprints that share 8 - most_bits positional
    bytes, hence at most 256**most_bits of them: its size has a fixed bound.
    """
    lists = (
        fps.select("fp", index_keys(F.col("fp"), most_bits).alias("key"))
        .groupBy("key.k", "key.bytes")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("fps")
    )

    def run(batches):
        for batch in batches:
            a, b = [], []
            for x in batch.column("fps"):
                for i, j in _link_bucket(x.values.to_numpy(zero_copy_only=False).view(np.uint64), most_bits):
                    a.append(i)
                    b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], names=["a", "b"])

    return lists.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text_col: str = "text", width: int = 3, most_bits: int = 2) -> DataFrame:
    """docs -> doc_id, fp, component_id (least doc_id of the component).

    Every row of docs gives one row. Null and empty texts have fingerprint 0
    and link like any other. Rows that repeat a doc_id stay; a null doc_id
    keeps its row and never names a component. Exact copies share one
    fingerprint and so meet the index once, whatever their number. Other
    columns of docs are ignored. An empty table gives an empty table.
    """
    rows = written(with_fingerprints(docs, text_col, width), "fingerprints")
    reps = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    reps = written(reps, "representatives")
    roots = connected_components(fingerprint_links(reps, most_bits))
    placed = reps.join(roots, reps.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = placed.join(least, "root").select("fp", "component_id")
    return rows.join(placed, "fp", "left").select("doc_id", "fp", "component_id")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
