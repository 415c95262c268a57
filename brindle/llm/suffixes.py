"""Exact removal of repeated byte strings: blockwise suffix sorting with a difference-cover sample.

Documents are dealt into groups of a few megabytes. Four passes exchange only
digests and strings that repeat between groups and buckets, never a row for
each suffix:

1. Cover sample. In a document, the places p with p mod 31 in a difference
   cover are sampled. Of two equal windows of 50 bytes, wherever they start,
   some place less than 31 bytes in is sampled in both, and the 20 bytes there
   lie in both windows. A group names its sampled strings and sends each
   bucket of names one sorted list.
2. Repeats. A bucket sees which names more than one group has, and answers each
   group with one bit a name. Only windows over a sample that repeats can
   repeat themselves; all others are settled.
3. Suffix buckets. The windows left go to the bucket of their least 12-byte
   string, so equal windows meet. Neighbouring windows of one bucket travel as
   one string, and a string that a group holds many times travels once, with
   its least document. A bucket ranks the cover sample of its strings, then
   sorts its suffixes one block of leading bytes at a time: by their first 32
   bytes, and where these tie by the ranks of the sampled places that two
   suffixes have at one distance. Neighbours that agree in 50 bytes, compared
   byte by byte, are one string, and the least document of each is found.
4. Back in its group, each window whose least document is smaller than its own
   marks its bytes, and marked bytes go.

Names only shut out windows that cannot repeat and pair up runs inside a
group, where equal names are compared byte by byte as well; what repeats is
decided by sorting. Tables are built for a piece of a few megabytes at a time,
so memory is bounded by a bucket, or by a group's or a long text's own bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import table

WIDTH = 50
#: A perfect difference cover modulo 31.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
SEED = WIDTH - MODULUS + 1
NO_DOC = (1 << 63) - 1
LONGEST_RUN = 4096
#: Bytes of the strings whose least name deals a window to its bucket.
DEAL = 12
#: Bytes of a group whose tables are held at a time; a longer text is cut, at a multiple of MODULUS.
PIECE = MODULUS * 200_000
#: Suffixes of a bucket that are sorted at a time.
BLOCK = 1 << 19

_M = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_TABLE = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IN_COVER = np.isin(np.arange(MODULUS), COVER)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse up to n at least, kept by the task for its next buffer."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_R, _RINV)):
            x = np.full(n + 1, np.uint64(base))
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS


class Names:
    """64-bit names of byte strings of one buffer, from prefix sums of a polynomial."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        up, self.down = _powers(n)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[buf] * up[:n], out=self.prefix[1:])

    def at(self, start: np.ndarray, size) -> np.ndarray:
        h = (self.prefix[start + size] - self.prefix[start]) * self.down[start]
        return self._mix(h)

    def all(self, size: int) -> np.ndarray:
        h = (self.prefix[size:] - self.prefix[:-size]) * self.down[: len(self.prefix) - size]
        return self._mix(h)

    @staticmethod
    def _mix(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def _bytes_of(tbl: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """Documents of a group in a fixed order: ids, bytes, offsets and the ordered table."""
    tbl = tbl.combine_chunks()
    ids = tbl.column("doc_id").to_numpy(zero_copy_only=False) if not tbl.column("doc_id").null_count else np.array([NO_DOC if x is None else x for x in tbl.column("doc_id").to_pylist()], np.int64)
    texts = tbl.column("raw").to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (int(ids[i]), texts[i]))
    offs = np.concatenate(([0], np.cumsum([len(texts[i]) for i in order]))).astype(np.int64)
    buf = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
    return ids[order].astype(np.int64), buf, offs, tbl.take(pa.array(order, pa.int64()))


def _pieces(offs: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Batches of pieces (document, start, end) of about PIECE bytes at most; pieces of one text overlap by WIDTH - 1, so each window lies in one."""
    batches, held = [[]], 0
    for k, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        for at in range(a, max(a + 1, b - WIDTH + 1), PIECE):
            end = min(b, at + PIECE + WIDTH - 1)
            if held and held + end - at > PIECE + WIDTH:
                batches.append([])
                held = 0
            batches[-1].append((k, at, end))
            held += end - at
    return batches


class Batch:
    """Some pieces of a group's documents side by side, with the names of their strings."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, pieces: list[tuple[int, int, int]]):
        at = np.array([(a, b) for _, a, b in pieces], np.int64).reshape(-1, 2)
        self.buf = np.concatenate([buf[a:b] for a, b in at]) if len(at) else np.zeros(0, np.uint8)
        size = at[:, 1] - at[:, 0]
        ends = np.cumsum(size)
        self.shift = at[:, 0] - (ends - size)  # from a place here to the place in the group
        self.piece = np.repeat(np.arange(len(at), dtype=np.int32), size)
        doc = np.array([k for k, _, _ in pieces], np.int64)
        self.doc_of = doc
        place = np.arange(len(self.buf)) - np.repeat(ends - size, size)
        self.room = (np.repeat(size, size) - place).astype(np.int32)
        long = np.repeat(np.diff(offs)[doc] >= WIDTH, size)
        # pieces of a text start at multiples of MODULUS, so places in a piece and in the text have one residue
        self.sampled = np.flatnonzero(_IN_COVER[place % MODULUS] & (self.room >= SEED) & long)
        self.names = Names(self.buf)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return self.doc_of[self.piece[at]]

    def in_group(self, at: np.ndarray) -> np.ndarray:
        return at + self.shift[self.piece[at]]


class Group:
    """The sampled names of a group, sorted by bucket."""

    def __init__(self, batches: Iterable[Batch], buckets: int):
        h, doc = (np.concatenate(x) for x in zip(*((b.names.at(b.sampled, SEED), b.doc(b.sampled)) for b in batches)))
        key = ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        order = np.argsort(key)
        k = key[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        first = np.flatnonzero(new)
        d = doc[order]
        self.unique = k[first]
        self.local = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(k) else np.zeros(0, bool)
        self.rank = np.empty(len(k), np.int64)
        self.rank[order] = np.cumsum(new) - 1
        bucket = (self.unique >> np.uint64(32)).astype(np.int64)
        self.bucket, self.start = np.unique(bucket, return_index=True)
        self.stop = np.append(self.start[1:], len(bucket))


def _squeezed(data: bytes) -> bytes:
    """data compressed, behind its size."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _packed(names: np.ndarray) -> bytes:
    """Ascending 32-bit names as steps, byte place by byte place, compressed: most leading bytes are zero."""
    steps = np.diff(names, prepend=np.uint32(0)).astype("<u4")
    return _squeezed(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unsqueezed(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


_SENT = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("names", pa.binary())])
_BITS = pa.schema([("grp", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])
_STRINGS = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("sizes", pa.binary()), ("least", pa.binary()), ("most", pa.binary()), ("data", pa.binary())])
_FOUND = pa.schema([("grp", pa.int64()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
#: Rows of _STRINGS and _FOUND whose bucket is below 0 carry a group's own runs past the buckets.
OWN = -1


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in schema)


def _send_names(buckets: int):
    def run(tbl: pa.Table) -> pa.Table:
        grp = tbl.column("grp")[0].as_py()
        _, buf, offs, _ = _bytes_of(tbl.select(["doc_id", "raw"]))
        g = Group((Batch(buf, offs, x) for x in _pieces(offs)), buckets)
        low = (g.unique & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return _rows(_SENT, [(int(b), grp, _packed(low[i:j])) for b, i, j in zip(g.bucket, g.start, g.stop)])

    return run


def _rank_names(tbl: pa.Table) -> pa.Table:
    """One bit for each name that a group sent: whether another group sent it too."""
    bucket = tbl.column("bucket")[0].as_py()
    order = np.argsort(tbl.column("grp").to_numpy(), kind="stable")
    grps = tbl.column("grp").to_numpy()[order].tolist()
    sent = tbl.column("names").to_pylist()
    lists = [_unpacked(sent[i]) for i in order]
    every = np.concatenate(lists)
    by = np.argsort(every, kind="stable")
    s = every[by]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:]
    twice = np.empty(len(s), bool)
    twice[by] = same
    ends = np.cumsum([len(x) for x in lists])
    return _rows(_BITS, [(g, bucket, np.packbits(twice[e - len(x) : e]).tobytes()) for g, x, e in zip(grps, lists, ends)])


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of h[i : i + width]."""
    out, have = h, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _runs(batch: Batch, hit: np.ndarray, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Runs of windows near a repeated sample: start in the group, bytes, bucket, document and name of each."""
    none = np.zeros(0, np.int64)
    n = len(batch.buf) - WIDTH + 1
    if n < 1 or not len(hit):
        return none, none, none, none, none.astype(np.uint64)
    marked = np.zeros(len(batch.buf) + MODULUS + 1, np.int32)
    marked[hit + 1] = 1
    np.cumsum(marked, out=marked)
    w = np.flatnonzero((marked[MODULUS : MODULUS + n] > marked[:n]) & (batch.room[:n] >= WIDTH))
    if not len(w):
        return none, none, none, none, none.astype(np.uint64)
    low = _sliding_least(batch.names.all(DEAL), WIDTH - DEAL + 1)[w]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1] + 1) | (low[1:] != low[:-1]) | (batch.piece[w[1:]] != batch.piece[w[:-1]])
    head = np.flatnonzero(new)
    run_no = np.cumsum(new) - 1
    new |= (np.arange(len(w)) - head[run_no]) % LONGEST_RUN == 0
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(w))) + WIDTH - 1
    start = w[head]
    return batch.in_group(start), size, (low[head] % np.uint64(buckets)).astype(np.int64), ids[batch.doc(start)], batch.names.at(start, size)


def _same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether buf[a : a + size] and buf[b : b + size] agree, for each of many pairs; some megabytes at a time."""
    out = np.ones(len(a), bool)
    ends = np.cumsum(size)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE, "right")))
        n = size[i:j]
        pair = np.repeat(np.arange(i, j), n)
        inside = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        out[pair[buf[a[pair] + inside] != buf[b[pair] + inside]]] = False
        i = j
    return out


def _send_strings(names_buckets: int, buckets: int):
    def run(tbl: pa.Table, bits: pa.Table) -> pa.Table:
        if not tbl.num_rows:
            return _rows(_STRINGS, [])
        grp = tbl.column("grp")[0].as_py()
        ids, buf, offs, _ = _bytes_of(tbl.select(["doc_id", "raw"]))
        if len(buf) < WIDTH:
            return _rows(_STRINGS, [])
        cut = _pieces(offs)
        batches = [Batch(buf, offs, x) for x in cut] if len(cut) == 1 else (Batch(buf, offs, x) for x in cut)
        g = Group(batches, names_buckets)
        twice = g.local.copy()
        at = {int(b): (i, j) for b, i, j in zip(g.bucket, g.start, g.stop)}
        for b, x in zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist()):
            i, j = at[b]
            twice[i:j] |= np.unpackbits(np.frombuffer(x, np.uint8))[: j - i].astype(bool)
        runs, seen = [], 0
        # a group of several pieces builds their tables again rather than hold them all
        for batch in batches if len(cut) == 1 else (Batch(buf, offs, x) for x in cut):
            hit = batch.sampled[twice[g.rank[seen : seen + len(batch.sampled)]]]
            seen += len(batch.sampled)
            runs.append(_runs(batch, hit, ids, buckets))
        start, size, bucket, owner, name = (np.concatenate(v) for v in zip(*runs))
        if not len(start):
            return _rows(_STRINGS, [])
        # equal strings of a group travel once, in the order of bucket, name and size
        order = np.lexsort((owner, size, name, bucket))
        first = np.ones(len(order), bool)
        a, b = order[1:], order[:-1]
        first[1:] = (name[a] != name[b]) | (size[a] != size[b]) | (bucket[a] != bucket[b])
        like = np.flatnonzero(~first)
        first[like] = ~_same_bytes(buf, start[order[like]], start[order[like - 1]], size[order[like]])
        heads = np.flatnonzero(first)
        last = np.append(heads[1:], len(order)) - 1
        pick = order[heads]
        string_no = np.empty(len(order), np.int64)
        string_no[order] = np.cumsum(first) - 1
        least, most = owner[order[heads]], owner[order[last]]
        out = []
        nb, i0 = np.unique(bucket[pick], return_index=True)
        view = memoryview(buf)
        for b, i, j in zip(nb.tolist(), i0.tolist(), np.append(i0[1:], len(pick)).tolist()):
            part = pick[i:j]
            data = b"".join(view[s : s + k] for s, k in zip(start[part].tolist(), size[part].tolist()))
            out.append((b, grp, size[part].astype("<i4").tobytes(), least[i:j].astype("<i8").tobytes(), most[i:j].astype("<i8").tobytes(), _squeezed(data)))
        out.append((OWN - grp, grp, start.astype("<i4").tobytes(), string_no.astype("<i4").tobytes(), np.append(i0, len(pick)).astype("<i4").tobytes(), nb.astype("<i8").tobytes()))
        return _rows(_STRINGS, out)

    return run


#: The least distance at which places of two residues are both sampled, and a residue's place in the cover.
_MEET = np.array([[next(d for d in range(MODULUS) if _IN_COVER[(a + d) % MODULUS] and _IN_COVER[(b + d) % MODULUS]) for b in range(MODULUS)] for a in range(MODULUS)], np.int64)
_COVER_NO = np.cumsum(_IN_COVER) - 1


class Suffixes:
    """Suffixes of a buffer, each told apart by its first bytes, in order."""

    def __init__(self, buf: np.ndarray):
        padded = np.concatenate((buf, np.zeros(2 * WIDTH + MODULUS + 8, np.uint8)))
        n = len(padded) - 7
        self.word = np.zeros(n, np.uint64)  # eight bytes from each place
        for k in range(8):
            self.word |= padded[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
        sampled = np.flatnonzero(_IN_COVER[np.arange(len(buf) + MODULUS) % MODULUS])
        order, new = self._split(sampled, lambda x, y, side: self._by_words(x, y, side, zip(self.words(x, 8), self.words(y, 8))))
        self.rank = np.empty(len(order), np.int32)  # of each sampled place, by WIDTH bytes
        self.rank[order] = np.cumsum(new)

    @staticmethod
    def _by_words(x: np.ndarray, y: np.ndarray, side: np.ndarray, words) -> None:
        for a, b in words:
            np.copyto(side, (a > b).view(np.int8) - (a < b).view(np.int8), where=side == 0)

    def _by_rank(self, x: np.ndarray, y: np.ndarray, side: np.ndarray) -> None:
        self._by_words(x, y, side, ((self.word[x + k], self.word[y + k]) for k in (8, 16, 24)))
        tied = np.flatnonzero(side == 0)
        x, y = x[tied], y[tied]
        far = _MEET[x % MODULUS, y % MODULUS]
        side[tied] = np.sign(self.rank_at(x + far) - self.rank_at(y + far))

    def _split(self, at: np.ndarray, compare) -> tuple[np.ndarray, np.ndarray]:
        """(order of the suffixes at `at`, whether each differs from the one before).

        First by eight bytes; what ties is split around one suffix of each tie,
        again and again: compare(suffixes, pivots, side) sets side to -1, 0 or 1.
        """
        first = self.word[at]
        order = np.argsort(first)
        new = np.ones(len(order), bool)
        new[1:] = first[order][1:] != first[order][:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(new)))
        start, size = start[size > 1], size[size > 1]
        while len(start):
            place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
            mine, pivot = at[order[place]], np.repeat(at[order[start + size // 2]], size)
            side = np.zeros(len(mine), np.int8)
            compare(mine, pivot, side)
            key = np.repeat(np.arange(len(start)), size) * 3 + side + 1
            if (key[1:] < key[:-1]).any():
                order[place] = order[place[np.argsort(key, kind="stable")]]
            many = np.bincount(key, minlength=3 * len(start)).reshape(-1, 3)
            begins = start[:, None] + np.cumsum(many, axis=1) - many
            new[begins[many > 0]] = True
            left = (many > 1) & np.array([True, False, True])  # what equals the pivot is done
            start, size = begins[left], many[left]
        return order, new

    def words(self, at: np.ndarray, skip: int) -> list[np.ndarray]:
        """Bytes skip to WIDTH from each place, eight at a time."""
        out = [self.word[at + k] for k in range(skip, WIDTH - WIDTH % 8, 8)]
        return [*out, self.word[at + WIDTH - WIDTH % 8] >> np.uint64(64 - 8 * (WIDTH % 8))]

    def rank_at(self, at: np.ndarray) -> np.ndarray:
        return self.rank[at // MODULUS * len(COVER) + _COVER_NO[at % MODULUS]]

    def blocks(self, at: np.ndarray):
        """Indexes of `at` in blocks of about BLOCK, ascending by their first eight bytes."""
        first = self.word[at]
        if len(at) <= BLOCK:
            yield np.arange(len(at))
            return
        some = np.sort(first[:: max(1, len(at) // 4096)])
        cuts = np.unique(some[:: max(1, len(some) * BLOCK // (2 * len(at)))])
        block = np.searchsorted(cuts, first, "right")
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.diff(block[order])) + 1
        yield from np.split(order, edges)

    def sort(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order of the suffixes at `at`, whether each differs from the one before in WIDTH bytes).

        By 32 bytes, then by rank: two suffixes have their ranks compared at
        the least distance at which both have a sampled place.
        """
        order, new = self._split(at, self._by_rank)
        # ranks look past WIDTH bytes: neighbours that a split tells apart may still agree so far
        check = np.flatnonzero(new)[1:]
        x, y = at[order[check]], at[order[check - 1]]
        differ = self.word[x] != self.word[y]
        for a, b in zip(self.words(x, 8), self.words(y, 8)):
            differ |= a != b
        new[check] = differ
        return order, new


def _least_documents(tbl: pa.Table) -> pa.Table:
    """Least document of every window of a bucket, sent back for windows that some document of a group may lose."""
    if tbl.column("bucket")[0].as_py() < 0:
        return _rows(_FOUND, [tuple(r[k] for k in ("grp", "bucket", "sizes", "least", "most", "data")) for r in tbl.to_pylist()])
    bucket = tbl.column("bucket")[0].as_py()
    grps = tbl.column("grp").to_pylist()
    sizes = [np.frombuffer(x, "<i4").astype(np.int64) for x in tbl.column("sizes").to_pylist()]
    per = np.array([len(x) for x in sizes])
    given = np.concatenate(sizes)
    least = np.concatenate([np.frombuffer(x, "<i8") for x in tbl.column("least").to_pylist()])
    most = np.concatenate([np.frombuffer(x, "<i8") for x in tbl.column("most").to_pylist()])
    data = b"".join(map(_unsqueezed, tbl.column("data").to_pylist()))
    ends = np.cumsum(given).tolist()
    # a string that several groups sent is sorted once
    known: dict[bytes, int] = {}
    number = np.fromiter((known.setdefault(data[a:b], len(known)) for a, b in zip([0, *ends], ends)), np.int64, len(ends))
    size = np.fromiter(map(len, known), np.int64, len(known))
    buf = np.frombuffer(b"".join(known), np.uint8)
    first_owner = np.full(len(size), NO_DOC)
    np.minimum.at(first_owner, number, least)
    begin = np.cumsum(size) - size
    n = size - WIDTH + 1
    first = np.cumsum(n) - n
    string = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(string)) - first[string]
    at = begin[string] + inside
    suffixes = Suffixes(buf)
    least_of = np.empty(len(at), np.int64)
    for block in suffixes.blocks(at):
        order, new = suffixes.sort(at[block])
        mine = block[order]
        low = np.minimum.reduceat(first_owner[string[mine]], np.flatnonzero(new))
        least_of[mine] = low[np.cumsum(new) - 1]
    # runs of windows of a string with one least document
    edge = np.ones(len(least_of), bool)
    edge[1:] = (string[1:] != string[:-1]) | (least_of[1:] != least_of[:-1])
    heads = np.flatnonzero(edge)
    count = np.diff(np.append(heads, len(edge)))
    run_first = np.searchsorted(string[heads], np.arange(len(size) + 1))
    # each string as it was sent gets the runs of its like that its last document may lose
    many = run_first[number + 1] - run_first[number]
    sent = np.repeat(np.arange(len(number)), many)
    run = np.arange(len(sent)) - np.repeat(np.cumsum(many) - many, many) + run_first[number[sent]]
    lost = least_of[heads[run]] < most[sent]
    sent, run = sent[lost], run[lost]
    count, inside, low = count[run], inside[heads[run]], least_of[heads[run]]
    base = np.cumsum(per) - per
    for_group = np.searchsorted(sent, np.append(base, len(number)))
    out = []
    for grp, at_first, i, j in zip(grps, base.tolist(), for_group[:-1].tolist(), for_group[1:].tolist()):
        if j > i:
            out.append((grp, bucket, (sent[i:j] - at_first).astype("<i4").tobytes(), inside[i:j].astype("<i4").tobytes(), count[i:j].astype("<i4").tobytes(), low[i:j].astype("<i8").tobytes()))
    return _rows(_FOUND, out)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary()), ("kept_sha256", pa.string())])


def _remove(with_bytes: bool):
    def run(tbl: pa.Table, found: pa.Table) -> pa.Table:
        if not tbl.num_rows:
            return _rows(_RESULT, [])
        ids, buf, offs, tbl = _bytes_of(tbl.select(["doc_id", "raw"]))
        own = None
        entries = []
        for r in found.to_pylist():
            if r["bucket"] < 0:
                own = r
            else:
                entries.append(r)
        if own is not None and entries:
            start, string_no = np.frombuffer(own["a"], "<i4").astype(np.int64), np.frombuffer(own["b"], "<i4").astype(np.int64)
            base = dict(zip(np.frombuffer(own["d"], "<i8").tolist(), np.frombuffer(own["c"], "<i4").tolist()))
            e_no = np.concatenate([np.frombuffer(r["a"], "<i4").astype(np.int64) + base[r["bucket"]] for r in entries])
            e_in, e_count = (np.concatenate([np.frombuffer(r[k], "<i4").astype(np.int64) for r in entries]) for k in "bc")
            e_least = np.concatenate([np.frombuffer(r["d"], "<i8") for r in entries])
            by = np.argsort(e_no, kind="stable")
            e_no, e_in, e_count, e_least = e_no[by], e_in[by], e_count[by], e_least[by]
            i, j = np.searchsorted(e_no, string_no, "left"), np.searchsorted(e_no, string_no, "right")
            many = j - i
            occ = np.repeat(np.arange(len(start)), many)
            entry = np.arange(len(occ)) - np.repeat(np.cumsum(many) - many, many) + i[occ]
            doc = np.searchsorted(offs, start, "right") - 1
            ok = e_least[entry] < ids[doc[occ]]
            a = start[occ[ok]] + e_in[entry[ok]]
            b = a + e_count[entry[ok]] + WIDTH - 1
            by = np.argsort(a, kind="stable")
            a, b = a[by], np.maximum.accumulate(b[by])
            fresh = np.ones(len(a), bool)
            # texts stand side by side, so a run that starts where the text before ends is a run of its own
            fresh[1:] = (a[1:] > b[:-1]) | np.isin(a[1:], offs)
            starts, ends = a[fresh], b[np.append(np.flatnonzero(fresh)[1:], len(a)) - 1] if len(a) else a
        else:
            starts = ends = np.zeros(0, np.int64)
        rows = []
        given = tbl.column("doc_id").to_pylist()
        edges = np.searchsorted(starts, offs)
        whole = memoryview(buf)
        for k in range(len(ids)):
            base, mine = int(offs[k]), slice(edges[k], edges[k + 1])
            s, e = (starts[mine] - base).tolist(), (ends[mine] - base).tolist()
            digest, kept = hashlib.sha256(), []
            for a, b in zip([0, *e], [*s, int(offs[k + 1]) - base]):
                digest.update(whole[base + a : base + b])
                if with_bytes:
                    kept.append(whole[base + a : base + b])
            rows.append((given[k], int(offs[k + 1]) - base, s, e, b"".join(kept) if with_bytes else None, digest.hexdigest()))
        return _rows(_RESULT, rows)

    return run


def remove_repeats(docs: DataFrame, with_bytes: bool = False, text_col: str = "text", group_bytes: int | None = None, buckets: int | None = None) -> DataFrame:
    """docs -> doc_id, n_bytes, starts, ends (of removed runs, in bytes), kept (bytes left, if asked for), kept_sha256.

    Each byte covered by a 50-byte string that also starts in a document with a
    smaller doc_id goes. Strings are judged on the input. Every row gives one
    row; null texts are empty, texts under 50 bytes lose nothing. Rows with the
    same doc_id do not remove from each other, repeated rows neither; a null
    doc_id stands above all others. Other columns are ignored, whatever their
    names. An empty table gives an empty table.

    Rows are dealt to groups by id and text, so no id, null or repeated, fills
    a group; a very long text is alone with its bytes, and its tables are built
    for a piece at a time. There are as many tasks as groups or buckets, so a
    task does not grow with the input.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    group_bytes = group_bytes or int(min(6e6, max(1e6, 136 * math.sqrt(total))))
    groups = max(1, math.ceil(total / group_bytes))
    names_buckets, buckets = buckets or max(1, math.ceil(total / 16e6)), buckets or max(1, math.ceil(total / 4e6))
    g = docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text_col), F.lit(groups)).cast("long").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"))
    g = g.repartition(groups, "grp")
    sent = g.groupBy("grp").applyInArrow(_send_names(names_buckets), _ddl(_SENT))
    bits = sent.repartition(names_buckets, "bucket").groupBy("bucket").applyInArrow(_rank_names, _ddl(_BITS)).repartition(groups, "grp")
    strings = g.groupBy("grp").cogroup(bits.groupBy("grp")).applyInArrow(_send_strings(names_buckets, buckets), _ddl(_STRINGS))
    found = strings.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_least_documents, _ddl(_FOUND)).repartition(groups, "grp")
    return g.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(_remove(with_bytes), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary, kept_sha256 string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept_sha256")
