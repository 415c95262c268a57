"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a fit reads at most, and the share of them that one text may have.
MOST_BYTES, ONE_TEXT = 8 << 20, 1 / 16


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; a null doc_id has fold null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def unused(name: str, taken: list[str]) -> str:
    """name, or name with as many underscores as it takes to be none of `taken` in any case."""
    have = {x.lower() for x in taken}
    while name.lower() in have:
        name += "_"
    return name


def kept_as(keep: tuple[str, ...]) -> list[Column]:
    """Kept columns under the names _k0, _k1, ...: mapInArrow takes no dotted names, and results cannot clash with these."""
    return [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keep)]


def kept_schema(rows: DataFrame, keep: tuple[str, ...]) -> str:
    """Schema text of kept_as, each type with a comma behind."""
    return "".join(f"_k{i} {rows.schema[f'_k{i}'].dataType.simpleString()}, " for i in range(len(keep)))


def named_back(df: DataFrame, keep: tuple[str, ...], results: tuple[str, ...]) -> DataFrame:
    """kept_as columns under their own names, then the results; a result whose name is kept gets an underscore more."""
    return df.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], *[F.col(r).alias(unused(r, list(keep))) for r in results])


def thinned(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` of rows by a hash of their key under a threshold that follows from their count: no sort, the same rows on every run."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def bounded(rows: DataFrame, most: int, most_bytes: int = MOST_BYTES) -> list:
    """rows(doc_id, text, ...) -> at most `most` different rows with at most most_bytes of text in all, the same on every run.

    Rows stand in the order of a hash over all their columns; a text over
    ONE_TEXT of the bound is passed over. Only sizes are fetched first, so no
    more text than the bound reaches the driver.
    """
    h = F.xxhash64(F.lit("row"), *rows.columns)
    sized = rows.select("*", h.alias("_h"), F.octet_length("text").alias("_b")).where(F.col("_b") <= int(most_bytes * ONE_TEXT))
    first = sized.groupBy("_h").agg(F.max("_b").alias("_b")).sort("_h").limit(most).collect()
    total, last = 0, None
    for r in first:
        total += r["_b"]
        if total > most_bytes:
            break
        last = r["_h"]
    if last is None:
        return []
    got = sized.where(F.col("_h") <= last).dropDuplicates(["_h"]).sort("_h").limit(most).select(*rows.columns)
    return got.collect()


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, most_bytes: int = MOST_BYTES) -> list[tuple[str, int]]:
    """At most `most` (text, label) of labelled documents outside the held-out fold, and at most most_bytes of text.

    A document labelled more than once has its largest label; null labels,
    texts and ids are left out. The sampled labels are a proven bound, so they
    are broadcast to the scan of the texts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out))
    few = thinned(known, "doc_id", most).groupBy("doc_id").agg(F.max("label").alias("label")).sort("doc_id").limit(2 * most)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return [(r.text, r.label) for r in bounded(texts.join(F.broadcast(few), "doc_id").select("doc_id", "text", "label"), most, most_bytes)]
