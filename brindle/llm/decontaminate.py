"""Benchmark decontamination by canonical templates: typed placeholders, hash-joined windows, slot consistency."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.samples import unused
from brindle.session import small_enough, table, written

WINDOW = 8
LEAST_SHARE = 0.5
#: Benchmark windows up to this number are broadcast; above it both sides are dealt out by the window's hash.
MOST_BROADCAST = 200_000

# Units that may follow a number.
UNITS = (
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg t oz lb lbs gram grams kilogram kilograms ounce ounces pound pounds ton tons ml cl l litre litres liter liters gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees kmh mph kb mb gb tb hz khz mhz ghz w kw v kv"
).split()

# Words that a capital does not make a name, as they start sentences.
FUNCTION_WORDS = (
    "a an the this that these those there here it its he she they we you his her their our your my if when while where which who whom whose what why how "
    "and or but so then thus hence yet for from in into on onto at by to of with without within as is are was were be been do does did has have had can could "
    "may might must shall should will would not no yes all any both each every few many more most much some such one two after before during since until because "
    "although though however also only let given find consider suppose assume calculate compute determine show prove write answer question "
    "der die das ein eine einer eines einem einen und oder aber wenn als wie was wer wo warum wann ich du er sie es wir ihr ist sind war im in am an auf aus bei mit nach von zu für "
    "le la les un une des du de et ou mais si quand comme que qui quoi où pourquoi il elle ils elles nous vous je tu est sont dans sur pour par avec ce cette ces "
    "el los las una unos unas y o pero si cuando como qué quién dónde por para con sin en es son este esta estos estas yo ella ellos nosotros"
).split()

NUMBER, NAME, UNIT = "\u0001n", "\u0001p", "\u0001u"
#: Tokens that a window begins with and that are looked up among the benchmark's before it is built, while these are so few.
FIRST, MOST_FIRST = 3, 50_000
#: Stands between a value of an item and its place.
PLACE = "\u0002"


def let(value: Column, use) -> Column:
    """use(value) with value worked out once, however often use() names it."""
    return F.transform(F.array(value), use).getItem(0)


def tokens(text: Column) -> Column:
    """Lower-case tokens of a text (letters and digits); placeholders keep their value behind a mark.

    A number becomes NUMBER + digits, a unit right behind a number UNIT + unit,
    and a capitalised word NAME + word wherever it stands, unless it is one of
    FUNCTION_WORDS. Null has no tokens.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\u0001", " ")
    units = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))

    def numbers(x: Column) -> Column:
        x = F.regexp_replace(x, r"(?i)(?<=[0-9])( ?)(" + units + r")(?![\p{L}\p{N}])", " " + UNIT + "$2")
        x = F.regexp_replace(x, r"(?<![\p{L}\p{N}\u0001])[0-9]++(?:[.,][0-9]++)*+", NUMBER + "$0")
        return F.regexp_replace(x, r"(?<=[0-9])[.,](?=[0-9])", "")  # a number's own separators do not cut it

    t = let(t, lambda x: F.when(x.rlike("[0-9]"), numbers(x)).otherwise(x))
    no_names = "|".join(sorted({w.capitalize() for w in FUNCTION_WORDS}))
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}\u0001])(?=\p{Lu}\p{Ll})(?!(?:" + no_names + r")(?![\p{L}\p{N}]))", NAME)
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}\u0001]+"), lambda x: x != "")


def kind(token: Column) -> Column:
    """The placeholder of a token, or the token."""
    return F.when(token.startswith("\u0001"), F.substring(token, 1, 2)).otherwise(token)


def literal(token: Column) -> Column:
    """A token whose name, if it is one, is read as a word."""
    return F.when(token.startswith(NAME), F.substring(token, 3, 1 << 20)).otherwise(token)


def form(tok: Column, reading) -> Column:
    """Hashes of the tokens as they are read."""
    return F.transform(tok, lambda x: F.xxhash64(reading(x)))


def places_of(hashes: Column, size: int) -> Column:
    """Places, from 1, where so many tokens stand in a row; an empty slice gives none."""
    n = F.size(hashes) - (size - 1)
    return F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), 1, F.greatest(n, F.lit(0)))


def beginning(hashes: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(hashes, at + (k - 1)) for k in range(size)])


def beginnings(items: DataFrame, size: int, most: int = MOST_FIRST) -> tuple[int, list[int]] | None:
    """Hashes of all runs of `size` tokens of the items, names read both ways; None if there are more than `most`."""

    def of(tok: Column) -> Column:
        both = (form(tok, kind), form(tok, lambda x: kind(literal(x))))
        return F.concat(*[let(h, lambda hh: F.transform(places_of(hh, size), lambda i: beginning(hh, i, size))) for h in both])

    got = items.select(F.explode(let(tokens(F.col("text")), of)).alias("b")).distinct().limit(most + 1).collect()
    return (size, [r.b for r in got]) if len(got) <= most else None


def one_of(hashes: list[int]):
    """Whether a hash is among these: they are one literal, dealt into short lists by their last bits, as a literal for each would fill the driver's memory."""
    n = 1 << len(hashes).bit_length()
    lists: list[list[int]] = [[] for _ in range(n)]
    for h in hashes:
        lists[h & (n - 1)].append(h)
    known = F.from_json(F.lit(json.dumps(lists)), "array<array<bigint>>")
    return lambda h: F.array_contains(F.get(known, h.bitwiseAND(F.lit(n - 1)).cast("int")), h)


def windows(docs: DataFrame, key: list[str | Column], text: Column, lengths: list[int], placed: bool = False, begins: tuple[int, list[int]] | None = None) -> DataFrame:
    """docs -> key, at (place of the window, from 1), w (hash of the template), h (hash of a form of it), slots (values of that form's placeholders).

    One row for each window of each of the lengths, and a second for a window
    with names: in its first form names are words, so that it matches however
    it is cased, in its second they are placeholders. A window without a word
    has no second form, nor has one under WINDOW tokens with as many names as
    words, as it would match by its length only. A window's hash is taken over
    the hashes of its tokens, so every token is hashed once for each form. With
    placed, a number or unit among the slots has its place in the text behind it.
    With begins (a number of tokens and the hashes of all beginnings that can
    match), windows that begin otherwise are not built.
    """

    def of(tok: Column) -> Column:
        return let(form(tok, kind), lambda hk: let(form(tok, lambda x: kind(literal(x))), lambda hl: let(places(hk, hl), lambda at_: F.concat(*[at(tok, hk, hl, at_, n) for n in lengths]))))

    def places(hk: Column, hl: Column) -> Column:
        size = begins[0] if begins else 1
        every = places_of(hk, size)
        if begins is None:
            return every
        known = one_of(begins[1])
        return F.filter(every, lambda i: known(beginning(hl, i, size)) | known(beginning(hk, i, size)))

    def at(tok: Column, hk: Column, hl: Column, places: Column, n: int) -> Column:
        def win(i: Column) -> Column:
            of_window = F.slice(tok, i, n)
            if placed:
                here = lambda x, k: F.when(x.startswith(NUMBER) | x.startswith(UNIT), F.concat(x, F.lit(PLACE), (i + k).cast("string"))).otherwise(x)
                of_window = F.transform(of_window, here)
            return let(F.filter(of_window, lambda x: x.startswith("\u0001")), lambda slots: forms(i, slots))

        def forms(i: Column, slots: Column) -> Column:
            plain = F.filter(slots, lambda x: ~x.startswith(NAME))
            names, words = F.size(slots) - F.size(plain), n - F.size(slots)
            second = (names > 0) & (words > (names if n < WINDOW else 0))
            template = F.xxhash64(F.slice(hk, i, n))
            one = lambda h, slots: F.struct(i.alias("at"), template.alias("w"), h.alias("h"), slots.alias("slots"))
            first = F.when(names > 0, F.xxhash64(F.slice(hl, i, n))).otherwise(template)
            return F.when(second, F.array(one(first, plain), one(template, slots))).otherwise(F.array(one(first, plain)))

        return F.flatten(F.transform(F.filter(places, lambda i: i <= F.size(hk) - (n - 1)), win))

    # lambda variables hold the tokens and their hashes: outside of one, the optimiser
    # would put the expressions themselves into the lambda and repeat them for each window
    every = let(tokens(text), of)
    return docs.select(*key, F.explode(every).alias("_w")).select("*", "_w.*").drop("_w")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    least_share: float = LEAST_SHARE,
    most_broadcast: int = MOST_BROADCAST,
    most_begins: int = MOST_FIRST,
) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, n_windows (of the item), n_matched, share, slots, consistent.

    A document holds an item if at least least_share of the item's template
    windows stand in it, and its placeholders are filled consistently. A slot of
    the item is a name, wherever it stands, or one place of a number or a unit,
    as two numbers may be alike by chance. In the windows that match, no slot may
    stand for two of the document's values, in more than half of the slots.
    Names match as words or as placeholders. An item may stand in a document several times: share and
    consistency are tested for each alignment (place in the document less place
    in the item), for stretches of half an item's length, which bear words put
    in or left out, and for the document as a whole, and one that passes is
    enough. The row is that of the most windows. Items shorter than a
    window are one window of their own length. Items without tokens match
    nothing; so do null and empty texts. Repeated documents are found alike,
    and a repeated item_id counts its texts as one item. Null ids are kept as
    they are. Other columns are ignored, and an empty table gives an empty one.
    """
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    sizes = items.select(F.least(F.size(tokens(F.col("text"))), F.lit(window)).alias("n")).where("n > 0").distinct()
    lengths = sorted(r.n for r in sizes.collect()) or [window]  # at most `window` values
    own = windows(items, ["item_id"], F.col("text"), [window], placed=True)
    short = [n for n in lengths if n < window]
    for n in short:
        one = items.where(F.size(tokens(F.col("text"))) == n)
        own = own.unionByName(windows(one, ["item_id"], F.col("text"), [n], placed=True))
    own = own.select("item_id", F.col("at").alias("item_at"), "w", "h", F.col("slots").alias("item_slots"))
    total = own.groupBy(F.col("item_id").alias("_item")).agg(F.count_distinct("w").alias("n_windows"))
    own = own.distinct()
    text = F.col("text")
    begins = beginnings(items, min([FIRST, *lengths]), most_begins)
    found = windows(docs.select("doc_id", "text").where(text.isNotNull()), ["doc_id", F.xxhash64("text").alias("body")], text, lengths, begins=begins).drop("w")
    fits = small_enough(own, most_broadcast)
    hit = found.join(F.broadcast(own) if fits else own, "h")
    hit = hit.join(F.broadcast(total) if fits else total, F.col("item_id").eqNullSafe(F.col("_item")))
    offset, half = F.col("at") - F.col("item_at"), F.greatest(F.floor(F.col("n_windows") / 4), F.lit(1)) * 2
    of_text = lambda kind, place: F.struct(F.lit(kind).alias("kind"), F.col("body"), place.cast("long").alias("place"))
    whole = F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("body"), F.lit(0).cast("long").alias("place"))
    groups = F.array(whole, of_text(1, offset), of_text(2, F.floor(offset / half)), of_text(3, F.floor((offset + half / 2) / half)))
    # pairs of (item value, document value) of each window: those of the form and place with the fewest changed values, then the most values
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    ranked = F.struct(F.size(F.filter(pairs, lambda p: F.substring_index(p["i"], PLACE, 1) != p["d"])).alias("changed"), (-F.size("slots")).alias("fewer"), pairs.alias("pairs"))
    per_place = hit.select("doc_id", "item_id", "n_windows", "w", "item_at", ranked.alias("best"), F.explode(groups).alias("group"))
    per_place = per_place.groupBy("doc_id", "item_id", "group", "w", "item_at").agg(F.min("best").alias("best"), F.first("n_windows").alias("n_windows"))
    per_group = per_place.groupBy("doc_id", "item_id", "group").agg(F.first("n_windows").alias("n_windows"), F.count_distinct("w").alias("n_matched"), F.flatten(F.collect_list("best.pairs")).alias("pairs"))
    values = F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    out = per_group.select("doc_id", "item_id", "n_windows", "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("share"), values.alias("slots"), (F.size(F.array_distinct("pairs")) - values).alias("clash"))
    out = out.withColumn("consistent", F.col("clash") * 2 <= F.col("slots")).where((F.col("share") >= least_share) & F.col("consistent"))
    row = F.struct("n_windows", "n_matched", "share", "slots", "consistent")
    return out.groupBy("doc_id", "item_id").agg(F.max_by(row, F.struct("n_matched", -F.col("clash"), "slots")).alias("row")).select("doc_id", "item_id", "row.*")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without those that hold a benchmark item; rows without a doc_id stay, and all columns, whatever their names."""
    name = unused("_bad", docs.columns)
    bad = contaminated(docs, benchmark, **how).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(name)).distinct()
    bad = written(bad, "contaminated")
    # beyond the checked size, documents are dealt out by doc_id once
    return docs.join(F.broadcast(bad) if small_enough(bad, MOST_BROADCAST) else bad, F.col("doc_id") == F.col(name), "left_anti")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
