"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from brindle.session import table, written

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents of a cell, if all documents were of one source and size class, and ranges of digests of a block of cells.
CELL, BLOCK = 20_000, 1024


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null has none.

    Each word with the white space around it becomes one letter. One more word
    is put behind and not counted, so that a text of white space alone has a
    word to be part of.
    """
    words = F.regexp_replace(F.concat(text, F.lit(" w")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]([^\x20\x09-\x0D]*+)[\x20\x09-\x0D]*+", "w")
    return F.coalesce(F.length(words) - 1, F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sizes(source, source_size, n) -> those with target.

    Sources by code point (null last) weigh as `weights` repeating. A target
    stops at `most` times its source; what is over is shared by weight among
    the rest. The result of that sharing is a water level: sources ordered by
    cap over weight fill up first, so one running sum finds it. There is one
    row a source here, never one a document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    k = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), (k + 1).cast("int")).cast("double")
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    upto, frm = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(frm))
    s = s.withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    s = s.withColumn("water", F.min(F.when(~F.col("full"), F.col("level"))).over(whole))
    # levels rise from each full source to the next, so the first that is not full has the final level
    s = s.withColumn("first_open", F.min(F.when(~F.col("full"), F.col("cap") / F.col("w"))).over(whole))
    s = s.withColumn("water", F.max(F.when(~F.col("full") & (F.col("cap") / F.col("w") == F.col("first_open")), F.col("level"))).over(whole))
    return s.select("source", "source_size", "n", F.when(F.col("full") | F.col("water").isNull(), F.col("cap")).otherwise(F.col("water") * F.col("w")).alias("target"))


def _offset(source: Column) -> Column:
    """One number in [0, 1) for each source, alike on every run."""
    name = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """docs -> _row (a struct of the kept columns), size, source_size, target, copies.

    Every document of a source is expected rate = target / source_size times.
    Documents stand in a fixed order inside their source; the running sum of
    rates plus one offset is cut at the integers, and a document is emitted
    once for each integer it crosses: floor(rate) or one more, so never above
    `most`. The order goes by size class (an eighth of a doubling) first, so
    that the words taken follow the target closely, then by a digest of id and
    text, then by a hash of the kept columns.

    The running sum needs only a document's rank, which comes from counts of
    cells (source, size class, range of digests) and a rank inside the cell.
    A class is cut into as many ranges of digests as leave CELL documents in
    each even if every document were in it, so no task holds a source or a
    class. Only rows alike in id and text must share a cell.

    Null texts and texts without words have size 0; null is a source of its
    own, last in order. A source without words has target 0 and is not
    emitted. Repeated rows are ranked one after another. An empty table gives
    an empty table. Other columns pass if named in keep.
    """
    tie = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    plain = [F.col(f"`{k}`") for k in keep if not isinstance(docs.schema[k].dataType, MapType)]
    rows = docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("_row"), F.xxhash64(*plain).alias("_other"), F.col("source").alias("_s"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_k"), word_count(F.col(text_col)).alias("size"), tie.alias("_tie"))
    rows = rows.withColumn("_class", F.floor(F.log2(F.col("size") + 1) * 8).cast("int"))
    if set(keep) <= {"doc_id", "source"}:
        rows = written(rows, "sizes")
    slots = max(1, -(-docs.count() // CELL))
    rows = rows.withColumn("_slot", F.floor(F.conv(F.substring("_tie", 1, 8), 16, 10).cast("double") / 4294967296.0 * slots))
    cells = rows.groupBy("_s", "_k", "_class", "_slot").agg(F.count("*").alias("_n"), F.sum("size").alias("_words"))
    cells = written(cells, "cells")
    sizes = cells.groupBy("_s").agg(F.sum("_words").alias("source_size"), F.sum("_n").alias("n")).withColumnRenamed("_s", "source")
    targets = source_targets(sizes, weights, most)
    # cells grow with the documents, so their running sum goes by blocks: few blocks a source, few cells a block
    cells = cells.withColumn("_block", F.floor(F.col("_slot") / BLOCK))
    earlier = lambda *by: Window.partitionBy("_s", *by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy("_s", "_class", "_block").agg(F.sum("_n").alias("_m"))
    blocks = blocks.select(F.col("_s").alias("_bs"), F.col("_class").alias("_bc"), F.col("_block").alias("_bb"), F.coalesce(F.sum("_m").over(earlier().orderBy("_class", "_block")), F.lit(0)).alias("_ahead"))
    inside_block = F.coalesce(F.sum("_n").over(earlier("_class", "_block").orderBy("_slot")), F.lit(0))
    cells = cells.withColumn("_inside", inside_block).join(blocks, F.col("_s").eqNullSafe(F.col("_bs")) & (F.col("_class") == F.col("_bc")) & (F.col("_block") == F.col("_bb")))
    cells = cells.withColumn("_before", F.col("_ahead") + F.col("_inside"))
    cells = cells.join(targets.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).select(
        "_k", "_class", "_slot", "_before", "source_size", "target"
    )
    inside = Window.partitionBy("_k", "_class", "_slot").orderBy("_tie", "_other")
    ranked = rows.withColumn("_in", F.row_number().over(inside) - 1)
    # the rank has dealt rows out by this key already, so they are not dealt out again
    ranked = ranked.join(cells, ["_k", "_class", "_slot"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = (F.col("_before") + F.col("_in")).cast("double")
    copies = F.floor(rate * (rank + 1) + _offset(F.col("_s"))) - F.floor(rate * rank + _offset(F.col("_s")))
    return ranked.select("_row", "size", F.col("source_size").cast("long"), "target", F.least(copies, F.lit(most)).cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs -> each emitted copy as a row with the columns of docs."""
    out = mix_sources(docs, keep=tuple(docs.columns), **how)
    return out.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("_row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: DuckDB SQL for op10, step by step the same sampling.
OP10_SQL = r"""
WITH rows AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS tie
  FROM documents),
sized AS (SELECT *, floor(log2(size + 1) * 8)::INT AS cls FROM rows),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size::DOUBLE * 3 AS cap,
      sum(source_size) OVER ()::DOUBLE AS total FROM src),
lv AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
water AS (SELECT max(level) AS water FROM lv WHERE NOT cap <= level * w AND cap / w = (SELECT min(cap / w) FROM lv WHERE NOT cap <= level * w)),
tg AS (SELECT source, source_size, CASE WHEN cap <= level * w OR water IS NULL THEN cap ELSE water * w END AS target FROM lv, water),
rk AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY cls, tie) - 1)::DOUBLE AS rank FROM sized),
un AS (SELECT rk.doc_id, rk.size, tg.source_size, tg.target, rank,
       CASE WHEN tg.source_size > 0 THEN tg.target / tg.source_size ELSE 0.0 END AS rate,
       ('0x' || substr(md5(coalesce('s' || rk.source, 'n')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
       FROM rk JOIN tg ON rk.source IS NOT DISTINCT FROM tg.source)
SELECT doc_id, size, source_size, target, (least(floor(rate * (rank + 1) + u) - floor(rate * rank + u), 3) * size)::BIGINT AS taken FROM un
"""
