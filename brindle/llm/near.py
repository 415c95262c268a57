"""Near copies by shingle similarity: MinHash bands as a positional index, and an exact prefix join where lists are long.

A plain SimHash bit is a majority over all shingles. Of two texts with a
Jaccard similarity of 0.8 about every seventh bit differs, so no byte position
is sure to match and the index of simhash.py has nothing to hold on to. Here
each position takes its value from one shingle only, the least under a hash of
its own, so it matches as often as the similarity says: that is MinHash, and
lists keyed by three positions are its bands. The steps of simhash.py apply:
lists of texts that share some positions, a tally of all shared positions of a
pair, a least number of matches, and an exact check of what is left. Texts in
lists too long to be tallied are joined by their rarest shingles instead,
which loses no pair. Groups may also follow the links of simhash.py, as the
pipeline's do: then these come first, and the similarity adds to them.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.samples import unused
from brindle.llm.simhash import fingerprint, fingerprint_links
from brindle.operators.dedup import components as connected_components
from brindle.session import small_enough, written

WIDTH, SIMILARITY = 5, 0.8
#: Positions of a fingerprint, and how many of them name a list: at 0.8 a pair misses all ten lists once in 1300.
POSITIONS, PER_LIST = 30, 3
#: Least number of shared positions of a pair to be checked (at 0.8, 24 are expected).
LEAST_SHARED = 15
#: A list up to this size has all its pairs tallied; texts of longer ones are joined exactly.
SHORT_LIST = 32
#: Up to so many texts that hold one shingle in front give candidate pairs; more are compared in cells of blocks of these sizes.
FEW = 64
BLOCK, BLOCK_SHINGLES = 512, 500_000
MOST_BROADCAST = 200_000

_RANDOM = np.random.default_rng(64)
_FACTORS = _RANDOM.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RANDOM.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLAB = 1 << 15


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text's words; fewer words than width are one shingle, none are an empty set."""
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    stops = ends[width - 1 :] if len(words) >= width else ends[-1:]
    pieces = map(line.__getitem__, map(slice, starts[:n].tolist(), stops.tolist()))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(5)), np.uint64, n))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def node_of(words: list[bytes]) -> int:
    """A 64-bit name of a sequence of words: texts that differ in case or blanks only have one."""
    return int.from_bytes(hashlib.md5(b" ".join(words)).digest()[:8], "little", signed=True)


def sampled_fingerprint(h: np.ndarray) -> np.ndarray:
    """POSITIONS values of 31 bits: at each, the least image of the shingles."""
    least = np.full(POSITIONS, 0x7FFFFFFF, np.uint64)
    for a in range(0, len(h), _SLAB):
        image = (h[a : a + _SLAB, None] * _FACTORS) >> np.uint64(33)
        np.minimum(least, image.min(axis=0), out=least)
    return least.astype(np.int32)


def list_keys(prints: np.ndarray) -> np.ndarray:
    """Keys of the lists that fingerprints (rows) stand in, one for each group of positions."""
    mixed = (prints.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(31)
    key = mixed.reshape(len(prints), -1, PER_LIST).sum(axis=2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def with_samples(docs: DataFrame, text_col: str, width: int, fingerprints: bool = False) -> DataFrame:
    """docs -> doc_id, node, n (shingles), print (array of int), keys (array of long), fp (SimHash fingerprint, or null where none is asked for)."""
    rows = docs.select("doc_id", F.col(text_col).alias("_text"))

    def run(batches):
        for batch in batches:
            nodes, sizes, prints, fps = [], [], [], []
            for t in batch.column("_text").to_pylist():
                w = _words(t)
                h = shingle_set(w, width)
                nodes.append(node_of(w))
                sizes.append(len(h))
                prints.append(sampled_fingerprint(h))
                fps.append(fingerprint(t) if fingerprints else 0)
            p = np.stack(prints) if prints else np.zeros((0, POSITIONS), np.int32)
            k = list_keys(p)
            as_lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))
            fp = pa.array(np.array(fps, np.uint64).view(np.int64)) if fingerprints else pa.nulls(len(fps), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), as_lists(p, pa.int32()), as_lists(k, pa.int64()), fp], names=["doc_id", "node", "n", "print", "keys", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node long, n long, print array<int>, keys array<long>, fp long")


def _shared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _tally_short(lists: DataFrame) -> DataFrame:
    """Lists(members: node, print) of at most SHORT_LIST -> pairs (a, b) that share LEAST_SHARED positions."""

    def run(batches):
        for batch in batches:
            out_a, out_b = [], []
            for x in batch.column("members"):
                nodes = x.values.field("node").to_numpy()
                prints = x.values.field("print").flatten().to_numpy().reshape(len(nodes), -1)
                same = (prints[:, None, :] == prints[None, :, :]).sum(axis=2)
                i, j = np.nonzero((same >= LEAST_SHARED) & (nodes[:, None] < nodes[None, :]))
                out_a.append(nodes[i])
                out_b.append(nodes[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)) for v in (out_a, out_b)], names=["a", "b"])

    return lists.mapInArrow(run, "a long, b long")


def _broadcast_if_few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small_enough(df, MOST_BROADCAST) else df


def candidate_lists(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """reps(node, n, print, keys), one row a node -> (distinct pairs (a, b) to check, nodes (node) of long lists).

    A short list has all its pairs tallied. In a long one each member is paired
    with the list's most typical text only, which links most copies of one text
    to it; `missing_links` finds what that leaves apart. Typical is the member
    with the largest weight: its lists have the most members, so its positions
    have the values that most members have. Rows of a long list are never dealt
    out by the list's key: sizes and typical texts are sums and maxima, joined
    back by broadcast while they are few.
    """
    entries = written(reps.select("node", F.explode("keys").alias("key")), "entries")
    sizes = written(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    long = _broadcast_if_few(sizes.where(F.col("size") > SHORT_LIST))
    rest = entries.join(long.select("key"), "key", "left_anti").join(sizes.where(F.col("size") <= SHORT_LIST).select("key"), "key")
    short = rest.join(reps.select("node", "print"), "node").groupBy("key").agg(F.collect_list(F.struct("node", "print")).alias("members"))
    pairs = _tally_short(short.select("members"))
    listed = written(entries.join(long, "key"), "long")
    if listed.isEmpty():
        return pairs.distinct(), listed.select("node")
    nodes = listed.groupBy("node").agg(F.sum("size").alias("weight")).join(reps.select("node", "print"), "node")
    nodes = written(nodes, "long_nodes")
    members = listed.select("key", "node").join(nodes, "node")
    centre = members.groupBy("key").agg(F.max(F.struct("weight", "node", "print")).alias("c")).select("key", F.col("c.node").alias("centre"), F.col("c.print").alias("centre_print"))
    stars = members.join(_broadcast_if_few(written(centre, "centres")), "key")
    stars = stars.where((F.col("node") != F.col("centre")) & (_shared(F.col("print"), F.col("centre_print")) >= LEAST_SHARED))
    return pairs.unionByName(stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))).distinct(), nodes.select("node")


def _meetings(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, right (w, node, n, root), at most FEW for a word -> pairs (a, b) of nodes that hold one w, of other roots; left is at least as long as right."""
    y = right.select("w", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("root").alias("root2"))
    met = left.select("w", "node", "n", "root").join(y, "w").where((F.col("root") != F.col("root2")) & (F.struct("n", "node") > F.struct("n2", "node2")))
    return met.select("n", "n2", F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def missing_links(sets: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """sets(node, shingles), nodes(node) of long lists, roots(node, root) so far -> the links (a, b) that are missing to connect all that are similar.

    Exact: two sets of at least that similarity share a shingle among the
    first few of each when all are ordered from rare to common: in the longer
    set the first n - ceil(similarity n) + 1, in the shorter the first
    n - ceil(2 similarity / (1 + similarity) n) + 1. What very many texts share
    stands last and brings nobody together. Pairs of one root need no check;
    of the texts that hold a shingle in front, those of its most frequent root
    are not compared with each other, so a large group of copies that is linked
    already costs its size, not its square. A shingle that few hold in front
    gives candidate pairs, one that many hold is worked through in cells.
    """
    s = sets.join(nodes, "node", "left_semi")
    # a shingle stands once in a text, so even one that all texts hold is one row in n of those dealt out here
    words = s.select("node", F.explode("shingles").alias("w")).withColumn("df", F.count("*").over(Window.partitionBy("w")))
    ordered = words.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("s")).withColumn("n", F.size("s"))
    kept = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-6).cast("int") + 1
    front = ordered.select("node", "n", F.posexplode(F.slice("s", F.lit(1), kept(similarity))).alias("at", "e"), kept(2 * similarity / (1 + similarity)).alias("short"))
    front = front.where("e.df > 1").join(roots, "node", "left")
    front = written(front.select("node", "n", F.coalesce("root", "node").alias("root"), F.col("e.w").alias("w"), (F.col("at") < F.col("short")).alias("first")), "fronts")
    main = front.groupBy("w", "root").agg(F.count("*").alias("size")).groupBy("w").agg(F.max(F.struct("size", "root")).alias("m"), F.count("*").alias("roots"), F.sum("size").alias("held"))
    front = written(front.join(main.where("roots > 1").select("w", F.col("m.root").alias("main"), "held"), "w"), "open_fronts")
    stray, few = F.col("root") != F.col("main"), front.where(F.col("held") <= FEW)
    pairs = _meetings(few.where(stray), few.where("first")).unionByName(_meetings(few.where(~stray), few.where(stray & F.col("first"))))
    pairs = pairs.where(F.least("n", "n2") >= F.greatest("n", "n2") * similarity - 1e-6).select("a", "b").distinct()
    return _checked(pairs, sets, similarity).unionByName(_cell_links(front.where(F.col("held") > FEW), sets, similarity))


def _cell_links(front: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """front(w, node, n, root, main) of shingles that many hold -> links (a, b) of nodes that are not of the main root with all others.

    Both sides are dealt into blocks, and a task compares one block of each. A
    pair that also shares an earlier such shingle is left to that one's cells.
    """
    stray = F.col("root") != F.col("main")
    size = lambda name: F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.lit(1)).alias(name)
    blocks = front.where(stray).groupBy("w").agg(size("lb")).join(front.groupBy("w").agg(size("rb")), "w")
    hot = front.groupBy("node").agg(F.sort_array(F.collect_list("w")).alias("hot"))
    full = sets.join(hot, "node")
    all_of = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    one_of = lambda name: F.pmod(F.xxhash64("node"), F.col(name))
    dealt = front.join(blocks, "w")
    x = dealt.where(stray).select("w", one_of("lb").alias("i"), all_of("rb").alias("j"), F.lit(True).alias("asks"), "node", "root")
    y = dealt.select("w", one_of("rb").alias("j"), all_of("lb").alias("i"), F.lit(False).alias("asks"), "node", "root")
    rows = x.unionByName(y).join(full, "node")
    cells = rows.groupBy("w", "i", "j").agg(F.collect_list(F.struct("asks", "node", "root", "hot", "shingles")).alias("members"))

    def run(batches):
        for batch in batches:
            for w, x in zip(batch.column("w").to_pylist(), batch.column("members")):
                a, b = _compare(w, x.values, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return cells.select("w", "members").mapInArrow(run, "a long, b long")


def _compare(w: int, members: pa.StructArray, similarity: float) -> tuple[list[int], list[int]]:
    """Links of the members that ask with those that do not, of other roots, in the cell of shingle w; one link to each other root does."""
    field = lambda k: members.field(k).to_numpy(zero_copy_only=False)
    asks, nodes, roots = field("asks"), field("node"), field("root")
    sets = [y.values.to_numpy() for y in members.field("shingles")]
    earlier = [y.values.to_numpy() for y in members.field("hot")]
    earlier = [y[: np.searchsorted(y, w)] for y in earlier]
    told = np.flatnonzero(~asks)
    a: list[int] = []
    b: list[int] = []
    if not len(told) or not asks.any():
        return a, b

    def shared_with(values: list[np.ndarray]):
        """For a set, how many of its values each told member has."""
        flat = np.concatenate([values[m] for m in told])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(told)), [len(values[m]) for m in told])[order]

        def count(own: np.ndarray) -> np.ndarray:
            lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            many = hi - lo
            return np.bincount(owner[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())], minlength=len(told))

        return count

    size = np.array([len(sets[m]) for m in told])
    common, before = shared_with(sets), shared_with(earlier)
    for i in np.flatnonzero(asks):
        open_ = (before(earlier[i]) == 0) & (roots[told] != roots[i])
        if not open_.any():
            continue
        shared = common(sets[i])
        linked = told[open_ & (shared >= similarity * (size + len(sets[i]) - shared) - 1e-9)]
        for j in linked[np.unique(roots[linked], return_index=True)[1]]:
            a.append(int(nodes[i]))
            b.append(int(nodes[j]))
    return a, b


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose shingle sets reach the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    links = both.select("a", "b", shared.alias("n"), (F.size("sa") + F.size("sb")).alias("sum"))
    return links.where(F.col("n") >= similarity * (F.col("sum") - F.col("n")) - 1e-9).select("a", "b")


def _sets_of(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """docs -> node, shingles (distinct 64-bit hashes)."""
    rows = docs.select(F.col(text_col).alias("_text"))

    def run(batches):
        for batch in batches:
            words = [_words(t) for t in batch.column("_text").to_pylist()]
            sets = [shingle_set(w, width).view(np.int64) for w in words]
            offs = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            data = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(offs), data)], names=["node", "shingles"])

    return rows.mapInArrow(run, "node long, shingles array<long>")


def simhash_links(reps: DataFrame, most_bits: int) -> DataFrame:
    """reps(node, fp) -> links (a, b) of nodes that connect all whose SimHash fingerprints link at most_bits or fewer differing bits, through the index of simhash.py.

    Nodes of one fingerprint are linked to the least of them, which stands for
    it in the index: any number of copies meets the index once.
    """
    least = written(reps.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    alike = reps.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    links = fingerprint_links(least.select("fp"), most_bits)
    links = links.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return alike.unionByName(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def near_copies(docs: DataFrame, text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, most_bits: int | None = None) -> DataFrame:
    """docs -> doc_id, node, component_id: the least doc_id reachable over pairs with at least that Jaccard similarity of word shingles.

    With most_bits, pairs whose SimHash fingerprints (as op1's: shingles of
    three words) differ in so many bits at most are links too, whatever their
    similarity.

    Every row gives one row. Texts that differ in ASCII case or blanks only
    are one node, as are all texts without words. Texts under `width` words
    are one shingle, so they link to equal ones only. A row without a doc_id
    has the component of its node's rows with one, else null, and is compared
    with no other text. Only a pair that shares none of the ten lists, or in a
    short list too few positions, can be missed. Rows that repeat a doc_id each
    count. Other columns are ignored. An empty table gives an empty table.
    """
    rows = written(with_samples(docs, text_col, width, most_bits is not None), "samples")
    reps = rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("print").alias("print"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    reps = written(reps, "nodes")
    pairs, long = candidate_lists(reps.where(F.col("rep").isNotNull()).select("node", "n", "print", "keys"))
    pairs = written(pairs, "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(long).distinct()
    asked = written(asked.join(reps.select("node", "rep"), "node"), "asked")
    ids = asked.select(F.col("rep").alias("doc_id")).distinct()
    # beyond the checked size, texts are dealt out by doc_id once
    texts = docs.join(_broadcast_if_few(ids), "doc_id", "left_semi")
    sets = written(_sets_of(texts, text_col, width).join(asked.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    links = _checked(pairs, sets, similarity)
    if most_bits is not None:
        links = simhash_links(reps.where(F.col("rep").isNotNull()).select("node", "fp"), most_bits).unionByName(links)
    links = written(links, "links")
    roots = connected_components(links)
    if not long.isEmpty():
        more = written(missing_links(sets, long, roots, similarity), "more_links")
        if not more.isEmpty():
            roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    placed = reps.select("node", "rep").join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = placed.join(least, "root").select("node", "component_id")
    return rows.select("doc_id", "node").join(placed, "node").select("doc_id", "node", "component_id")


def one_of_each(docs: DataFrame, text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, most_bits: int | None = None) -> DataFrame:
    """docs with one document of each group of near copies: that with the least doc_id. All columns stay.

    A doc_id stays if any of its rows is the first of its group. Rows repeated
    with their doc_id and text stay once. Rows without a doc_id stay.
    """
    found = written(near_copies(docs, text_col, width, similarity, most_bits), "groups")
    named = found.where(F.col("doc_id").isNotNull())
    per_id = named.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("first"), F.count("*").alias("n"))
    per_id = written(per_id, "decisions")
    name = unused("_gone", docs.columns)
    gone = per_id.where("first = 0").select(F.col("doc_id").alias(name))
    # beyond the checked size, documents are dealt out by doc_id once
    kept = docs.join(_broadcast_if_few(gone), F.col("doc_id") == F.col(name), "left_anti")
    if per_id.where("n > 1").isEmpty():
        return kept
    again = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", text_col])
    return again.union(kept.where(F.col("doc_id").isNull()))
