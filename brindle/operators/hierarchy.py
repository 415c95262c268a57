"""Places as a hierarchy: which nodes a text names, and the most specific node that holds all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.vocabulary import segmented, spans

MOST_LEVELS = 16


def with_paths(nodes: DataFrame) -> DataFrame:
    """nodes(node, parent) -> node, path (from the root to the node itself).

    Each round joins nodes with the paths of the round before, so there are as
    many rounds as levels; a parent that is unknown makes a root, and nodes of
    a circle have no path.
    """
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    rows = nodes.select("node", "parent").join(known, "parent", "left")
    level = rows.where(F.col("known").isNull()).select("node", F.array("node").alias("path"))
    below = rows.where("known").select("node", "parent")
    out = level
    for _ in range(MOST_LEVELS):
        level = below.join(level.select(F.col("node").alias("parent"), "path"), "parent").select("node", F.concat("path", F.array("node")).alias("path"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"more than {MOST_LEVELS} levels")


def shared_beginning(a: Column, b: Column) -> Column:
    """What two arrays have in common from the beginning on."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    n = F.array_position(same, False)
    return F.slice(a, F.lit(1), F.when(n > 0, (n - 1).cast("int")).otherwise(F.least(F.size(a), F.size(b))))


def _holding(paths: Column) -> Column:
    """The path of the most specific node above or at the ends of all paths: in order, what first and last have in common all share."""
    return shared_beginning(F.array_min(paths), F.array_max(paths))


def resolved(texts: DataFrame, key: str, text: str, names: DataFrame, nodes: DataFrame, apart: str = r";|/|\bor\b|\band\b") -> DataFrame:
    """texts, names(node, spelling), nodes(node, parent) -> doc, offices (parts of the text that name a node), node and path: the most specific node that holds all offices; null if none is named.

    A text is cut into offices. Names are found longest first. A node that
    lies above another one of its office only says where that one is, and
    is left out; what is left has the most specific node that holds it all.
    A name that several nodes bear is the least of them. Null texts name nothing.
    """
    parts = texts.select(F.col(key).alias("of"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), apart)).alias("part", "said"))
    parts = parts.select("of", F.struct("of", "part").alias("office"), "said")
    vocabulary = names.select(F.col("node").alias("entry"), "spelling", F.lit(False).alias("cased"))
    found = segmented(spans(parts, "office", "said", vocabulary)).select("doc", F.col("entry").alias("node")).distinct()
    paths = found.join(F.broadcast(with_paths(nodes)), "node") if nodes.count() <= 100_000 else found.join(with_paths(nodes), "node")
    lists = paths.groupBy("doc").agg(F.collect_set("path").alias("p"))
    lowest = F.filter("p", lambda a: ~F.exists("p", lambda b: (F.size(b) > F.size(a)) & (F.slice(b, F.lit(1), F.size(a)) == a)))
    offices = lists.select(F.col("doc.of").alias("of"), _holding(lowest).alias("path"))
    whole = offices.groupBy("of").agg(F.count("*").alias("offices"), F.min("path").alias("lo"), F.max("path").alias("hi")).select("of", "offices", shared_beginning(F.col("lo"), F.col("hi")).alias("path"))
    out = texts.select(F.col(key).alias("of")).distinct().join(whole, "of", "left")
    node = F.when(F.size("path") > 0, F.element_at("path", -1))
    return out.select(F.col("of").alias("doc"), F.coalesce("offices", F.lit(0)).alias("offices"), node.alias("node"), F.when(F.size("path") > 0, F.col("path")).alias("path"))
