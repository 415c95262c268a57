"""Repair of conversations: cheapest edits to a regular order of roles, found over arcs that are tight both ways."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import small_enough, table, written

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a conversation that are worked through at once.
SEGMENT = 1 << 15
MOST_BROADCAST = 200_000

# The order of roles as an automaton: a state is what was said last. An answer, or nothing at all, may end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (START, ASSISTANT)
FAR = 1 << 40

INITIALS = "sua"
NAME = {"u": "user", "a": "assistant"}
#: A row's code: its initial (index in INITIALS, or 3), and whether it must go or is cut short.
OTHER, GOES, CUT = 3, 4, 8
CODES = 16


def row_arcs(code: int) -> list[tuple[int, int, int, str, str]]:
    """(state, next state, cost, letter, initial) of all edits of a row that consume it."""
    arcs = [(q, q, DELETE, "D", "") for q in NEXT]
    if code & GOES:
        return arcs
    more = TRUNCATED if code & CUT else 0
    own = (*INITIALS, "")[code & 3]
    for q, to in NEXT.items():
        for x, r in to.items():
            if x == own:
                arcs.append((q, r, more, "K", x))
            if x in NAME:
                arcs.append((q, r, REROLE + more, "R", x))
    return arcs


INSERTS = [(q, r, INSERT, "I", x) for q, to in NEXT.items() for x, r in to.items() if x in NAME]
ARCS = [row_arcs(c) for c in range(CODES)]


def _matrix(arcs) -> np.ndarray:
    m = np.full((4, 4), FAR, np.int64)
    for q, r, c, *_ in arcs:
        m[q, r] = min(m[q, r], c)
    return m


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cheapest ways through a, then b (matrices of state to state, any number of them)."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), FAR)


def _closure() -> np.ndarray:
    """Cheapest ways between states by inserting alone."""
    m = np.minimum(_matrix(INSERTS), np.where(np.eye(4, dtype=bool), 0, FAR))
    return _meet(_meet(m, m), _meet(m, m))


INSERTING = _closure()
#: What inserting and then one row cost, for each code.
STEP = np.stack([_meet(INSERTING, _matrix(a)) for a in ARCS])
_ROW = np.stack([_matrix(a) for a in ARCS])
#: What is left to pay behind the last row.
LAST = _meet(INSERTING, np.array([[0 if q in ENDS else FAR] for q in NEXT]))[:, 0]


def passage(codes: np.ndarray) -> np.ndarray:
    """Costs from each state in front of a segment's rows to each state behind them, by halving."""
    m = STEP[codes]
    while len(m) > 1:
        pairs = _meet(m[0 : len(m) // 2 * 2 : 2], m[1::2])
        m = np.concatenate([pairs, m[-1:]]) if len(m) % 2 else pairs
    return m[0]


def tight_edits(codes: np.ndarray, ahead: np.ndarray, behind: np.ndarray, is_last: bool) -> dict[int, tuple[list[tuple[str, str, int]], int]]:
    """Entry state -> (edits, state behind) for the entry states that cheapest edits pass; an edit is a letter, the initial it gives and the row it stands at.

    ahead: cheapest costs from the conversation's beginning to each state in
    front of the segment; behind: from each state behind the segment to the
    end. Both are carried over all nodes (row, state), inserting included. An
    arc is tight if what leads to it, its own cost and what follows it make the
    least total. From the set of nodes that the letters so far can have reached,
    the least letter among the tight arcs is taken, and all nodes it reaches
    are the next set.
    """
    n = len(codes)
    back = np.empty((n + 1, 4), np.int64)
    back[n] = behind
    for i in range(n - 1, -1, -1):
        back[i] = (STEP[codes[i]] + back[i + 1]).min(axis=1)
    forth = np.empty((n + 1, 4), np.int64)
    forth[0] = (ahead[:, None] + INSERTING).min(axis=0)
    for i in range(n):
        forth[i + 1] = ((forth[i][:, None] + _ROW[codes[i]]).min(axis=0)[:, None] + INSERTING).min(axis=0)
    total = int((forth[0] + back[0]).min())
    fw, bw = forth.tolist(), back.tolist()
    out = {}
    for entry in range(4):
        if ahead[entry] + back[0][entry] != total:
            continue
        at, front, edits = 0, {entry: int(ahead[entry])}, []
        while True:
            arcs: dict[str, dict[int, tuple[int, str]]] = {}
            for q, paid in front.items():
                # inserting behind the last row belongs to the segment that follows, or to the last one
                steps = [(r, at, c, x, y) for p, r, c, x, y in INSERTS if p == q] if at < n or is_last else []
                steps += [(r, at + 1, c, x, y) for p, r, c, x, y in ARCS[codes[at]] if p == q] if at < n else []
                for r, i, c, x, y in steps:
                    if paid + c == fw[i][r] and fw[i][r] + bw[i][r] == total:
                        arcs.setdefault(x, {})[r] = (i, y)
            if not arcs:
                break
            x = min(arcs)
            i, y = next(iter(arcs[x].values()))
            edits.append((x, y, at))
            at, front = i, {r: fw[i][r] for r in arcs[x]}
        out[entry] = (edits, next(iter(front)))
    return out


# ------------------------------------------------------------------ rows


def _blank() -> Column:
    return ~F.col("text").rlike(r"[^\x20\x09-\x0D]")


def ordered_rows(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, turn, role, text, seg, pos (place in seg), code, blank, duplicate, truncated; written.

    Rows stand by turn (null first), role and text, and are dealt out by
    ranges of that order over all conversations: a long conversation is spread
    over several tasks, and equal rows stand side by side in one. seg numbers
    the stretches of a conversation in its order.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("said", F.md5(F.concat_ws("\n", "role", "text")))
    # what is said more than once in a conversation, and when first: a null turn comes before all
    again = rows.groupBy("conv_id", "said").agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("no_turn")).where("n > 1")
    again = written(again.select(F.col("conv_id").alias("_c"), F.col("said").alias("_s"), F.when(~F.col("no_turn"), F.col("first")).alias("first"), F.lit(True).alias("again")), "said_again")
    side = F.broadcast(again) if small_enough(again, MOST_BROADCAST) else again
    rows = rows.join(side, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("said") == F.col("_s")), "left")
    order = ["conv_id", "turn", "role", F.substring("text", 1, 32)]
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*+\z", 1)
    initial = F.substring("role", 1, 1)
    rows = rows.select(
        "conv_id", "turn", "role", "text", _blank().alias("blank"), (F.coalesce("again", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first"))).alias("later"),
        (~last.isin(".", "!", "?")).alias("unended"), F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS)), initial) - 1, F.lit(-1)).cast("int").alias("initial"),
    )
    dealt = rows.repartitionByRange(*order).sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        part, before, seg, pos = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            convs, turns, roles, texts, blanks, laters, cut, initials = (c.to_pylist() for c in batch.columns)
            segs, places, codes, dups, cuts = [], [], [], [], []
            for row in zip(convs, turns, roles, texts, blanks, laters, cut, initials):
                if before is None or row[0] != before[0]:
                    seg, pos = part << 32, 0
                elif pos == SEGMENT:
                    seg, pos = seg + 1, 0
                dup = not row[4] and (row[5] or before == row[:4])
                short = not row[4] and not dup and row[6]
                segs.append(seg)
                places.append(pos)
                dups.append(dup)
                cuts.append(short)
                codes.append((row[7] if row[7] >= 0 else OTHER) | (GOES if row[4] or dup else 0) | (CUT if short else 0))
                before, pos = row[:4], pos + 1
            more = [pa.array(segs, pa.int64()), pa.array(places, pa.int32()), pa.array(codes, pa.int32()), pa.array(dups, pa.bool_()), pa.array(cuts, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *more], names=["conv_id", "turn", "role", "text", "blank", "seg", "pos", "code", "duplicate", "truncated"])

    return written(dealt.mapInArrow(run, f"conv_id {_kind(rows)}, turn long, role string, text string, blank boolean, seg long, pos int, code int, duplicate boolean, truncated boolean"), "ordered")


REGULAR = {(0, 1), (1, 2), (2, 1)}


def irregular(initials: list[int]) -> int:
    """Neighbours whose initials do not follow one another in the order of roles."""
    return sum(p not in REGULAR for p in zip(initials, initials[1:]))


def segments_of(rows: DataFrame) -> DataFrame:
    """ordered rows -> conv_id, seg, codes (in order, at most SEGMENT), passage (16 costs), irregular (neighbours inside); written."""
    lists = rows.groupBy("conv_id", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("codes"))

    def run(batches):
        for batch in batches:
            codes = batch.column("codes").to_pylist()
            ways = pa.array([passage(np.array(c)).ravel().tolist() for c in codes], pa.list_(pa.int64()))
            wrong = pa.array([irregular([x & 3 for x in c]) for c in codes], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ways, wrong], names=["conv_id", "seg", "codes", "passage", "irregular"])

    return written(lists.mapInArrow(run, f"conv_id {_kind(rows)}, seg long, codes array<int>, passage array<long>, irregular long"), "segments")


def _kind(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def _per_conversation(rows: DataFrame, fields: list[str], work, schema: str) -> DataFrame:
    """work(conv_id, its segments in order) -> rows, for each conversation; a segment is a few numbers here."""
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", *fields))).alias("s"))
    types = conv.select(F.col("conv_id").alias("c")).schema
    shape = pa.schema([("c", _arrow(types["c"].dataType)), *schema_of(schema)])

    def run(batches):
        for batch in batches:
            out = [(c, *r) for c, s in zip(batch.column("conv_id").to_pylist(), batch.column("s").to_pylist()) for r in work(s)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(shape)], schema=shape)

    return conv.mapInArrow(run, f"c {_kind(rows)}, {schema}")


_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def schema_of(text: str) -> list[tuple[str, pa.DataType]]:
    return [(n, _TYPES[t]) for n, t in (x.split(" ") for x in text.split(", "))]


def _arrow(kind) -> pa.DataType:
    from_spark = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return from_spark[kind.simpleString()]


def _around(s: list[dict]):
    """Costs ahead of and behind each segment, whether it is the last, the whole cost and the irregular neighbours."""
    ways = [np.array(x["passage"]).reshape(4, 4) for x in s]
    ahead, behind = [np.array([0, FAR, FAR, FAR])], [LAST]
    for m in ways[:-1]:
        ahead.append(np.minimum((ahead[-1][:, None] + m).min(axis=0), FAR))
    for m in reversed(ways[1:]):
        behind.append(np.minimum((m + behind[-1]).min(axis=1), FAR))
    cost = int((ahead[-1][:, None] + ways[-1] + LAST).min())
    wrong = sum(x["irregular"] for x in s) + sum((x["last"] & 3, y["first"] & 3) not in REGULAR for x, y in zip(s, s[1:]))
    for k, (x, a, b) in enumerate(zip(s, ahead, reversed(behind))):
        yield x["seg"], a.tolist(), b.tolist(), k == len(s) - 1, cost, wrong


def _followed(s: list[dict]):
    """The state that each segment is entered in."""
    state = START
    for x in s:
        yield x["seg"], state
        state = next(w["leave"] for w in x["w"] if w["enter"] == state)


def edits_of(segments: DataFrame) -> DataFrame:
    """segments -> conv_id, seg, cost and irregular (of the conversation), edits (array of edit, made, pos) chosen; written.

    Only what a segment costs from state to state (16 numbers) goes to where
    a conversation's segments meet; costs ahead and behind come from there.
    Each segment is then edited for every state that cheapest edits can enter
    it in, and the states are followed from segment to segment.
    """
    ends = segments.select("conv_id", "seg", "passage", "irregular", F.element_at("codes", 1).alias("first"), F.element_at("codes", -1).alias("last"))
    costs = _per_conversation(ends, ["passage", "irregular", "first", "last"], _around, "g long, ahead array<long>, behind array<long>, is_last boolean, cost long, wrong long")
    here = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("g"))
    full = segments.select("conv_id", "seg", "codes").join(costs, here).drop("c", "g")

    def edit(batches):
        one = pa.struct([("edit", pa.string()), ("made", pa.string()), ("pos", pa.int32())])
        kinds = pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("edits", pa.list_(one))]))
        for batch in batches:
            out = []
            for codes, a, b, last in zip(*[batch.column(k).to_pylist() for k in ("codes", "ahead", "behind", "is_last")]):
                got = tight_edits(np.array(codes), np.array(a), np.array(b), last)
                out.append([{"enter": q, "leave": r, "edits": [{"edit": x, "made": y, "pos": i} for x, y, i in e]} for q, (e, r) in got.items()])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("conv_id", "seg", "cost", "wrong")], pa.array(out, kinds)], names=["conv_id", "seg", "cost", "irregular", "ways"])

    shape = "array<struct<enter:int,leave:int,edits:array<struct<edit:string,made:string,pos:int>>>>"
    ways = written(full.mapInArrow(edit, f"conv_id {_kind(segments)}, seg long, cost long, irregular long, ways {shape}"), "ways")
    slim = ways.select("conv_id", "seg", F.transform("ways", lambda w: F.struct(w["enter"].alias("enter"), w["leave"].alias("leave"))).alias("w"))
    entered = _per_conversation(slim, ["w"], _followed, "g long, q int")
    way = F.element_at(F.filter("ways", lambda w: w["enter"] == F.col("q")), 1)
    return written(ways.join(entered, here).select("conv_id", "seg", "cost", "irregular", way["edits"].alias("edits")), "edits")


def repaired_rows(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """ordered rows, edits -> conv_id, seg, k (place in seg), edit (K, R or I), role, text of the repaired conversations."""
    each = edits.select(F.col("conv_id").alias("c"), F.col("seg").alias("g"), F.posexplode("edits").alias("k", "x")).select("c", "g", "k", "x.edit", "x.made", F.col("x.pos").alias("p")).where("edit != 'D'")
    name = F.element_at(F.create_map(*[F.lit(v) for kv in NAME.items() for v in kv]), F.col("made"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("g")) & (F.col("pos") == F.col("p"))
    had = each.where("edit != 'I'").join(rows.select("conv_id", "seg", "pos", "role", "text"), same)
    kept = had.select("c", "g", "k", "edit", F.when(F.col("edit") == "R", name).otherwise(F.col("role")).alias("role"), "text")
    new = each.where("edit = 'I'").select("c", "g", "k", "edit", name.alias("role"), F.lit("").alias("text"))
    return kept.unionByName(new).select(F.col("c").alias("conv_id"), F.col("g").alias("seg"), "k", "edit", "role", "text")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conversations(conv_id, turn, role, text) -> (a row for each conversation, the rows of the repaired conversations).

    The first: conv_id, gaps, blank, duplicate, truncated, irregular
    (neighbours out of order), cost, audit (letters of the edits). The second:
    conv_id, seg, k, edit, role, text, in the order of seg and k; deleted rows
    are not in it. Roles are read by their first letter; a row of any other
    letter is renamed or deleted.

    Rows stand by turn (null first), role and text. Null roles and texts are
    one blank. Repeated rows are duplicates but for the first, unless blank. A
    null conv_id is a conversation of its own (string, int and long ids). Other
    columns are ignored, whatever their names. Empty tables give empty tables.

    A long conversation is cut into segments that are worked on apart, and
    only 16 costs a segment meet in one place, so a conversation that holds a
    third of all rows is no task of its own. Only rows of one turn and role
    that begin alike (32 characters) stay together.
    """
    rows = ordered_rows(conversations)
    edits = edits_of(segments_of(rows))
    audit = F.transform(F.array_sort(F.collect_list(F.struct("seg", F.array_join(F.transform("edits", lambda e: e["edit"]), "").alias("a")))), lambda x: x["a"])
    told = edits.groupBy(F.col("conv_id").alias("c")).agg(F.max("cost").alias("cost"), F.max("irregular").alias("irregular"), F.array_join(audit, "").alias("audit"))
    turns = rows.groupBy("conv_id", "turn").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0).cast("long")).alias("gaps")
    faults = turns.groupBy("conv_id").agg(gaps, *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    whole = faults.join(told, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "irregular", "cost", "audit")
    return whole, repaired_rows(rows, edits)


def digests(repaired: DataFrame) -> DataFrame:
    """Rows of repaired conversations -> conv_id, sha256 of `role:text` joined by newlines; rows stream by, only a running digest is held."""
    ordered = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "k").select("conv_id", F.concat_ws(":", "role", "text").cast("binary").alias("line"))

    def run(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for c, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if sha is not None and c == key:
                    sha.update(b"\n")
                else:
                    if sha is not None:
                        out.append((key, sha.hexdigest()))
                    key, sha = c, hashlib.sha256()
                sha.update(line)
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.string())], names=["conv_id", "sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([sha.hexdigest()])], names=["conv_id", "sha256"])

    return ordered.mapInArrow(run, f"conv_id {_kind(repaired)}, sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations -> rows of which one in 20 each is dropped, emptied, cut short, repeated or given to the user, by a hash of its place."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), h.alias("h")).where("h != 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.drop("col")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "conversations").withColumn("conv_id", F.col("conv_id").cast("long"))
    whole, repaired = repair(damaged(source))
    every = source.select(F.col("conv_id").alias("id")).distinct()
    out = every.join(whole, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    out = out.join(digests(repaired), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    count = lambda c, name=None: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(name or c)
    sha = F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return out.select(F.col("id").alias("conv_id"), *map(count, ("gaps", "blank", "duplicate", "truncated")), count("irregular", "illegal"), count("cost"), F.coalesce("audit", F.lit("")).alias("audit"), sha)
