"""Quality rules whose cutoffs are certified: labelled holdouts, exact binomial bounds, one error budget for all strata."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.samples import kept_as, kept_schema, named_back
from brindle.session import small_enough, table, written

WINDOW = 5
#: Base rules: fewest words, and the largest share (percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Share of a stratum's good texts that may be rejected, and the chance that any stratum's share is larger all the same.
RISK, ERROR = 0.02, 0.05
#: Shares of good texts that a rule may reject while cutoffs are tuned, from mild to strict, and what a rejected good text costs against a bad one.
LEVELS, PRICE = (0.0, 0.001, 0.002, 0.005, 0.01, 0.02), 5.0
#: A value's steps: cutoffs are whole numbers of them.
STEPS = 1000
MOST_BROADCAST = 200_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_open_lines", "n_upper", "n_lettered", "n_distinct")
_SPACE, _SYMBOLS, _UPPER = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91))
_NO_CHARACTER = _SPACE + bytes(range(0x80, 0xC0))
_LETTERED = re.compile(rb"[A-Za-z\x80-\xff][^\x20\x09-\x0d]*")


def rule_values() -> dict[str, Column]:
    """Rules as numbers that grow the worse a text is; each is about 0 to 1."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return {
        "long_words": F.least(F.col("word_chars") / n / 20, F.lit(1.0)),
        "short_words": 1 - F.least(F.col("word_chars") / n / 20, F.lit(1.0)),
        "symbols": F.col("n_symbols") / chars,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeats": F.col("n_repeat_words") / n,
        "wordless": 1 - F.col("n_lettered") / n,
        "capitals": F.col("n_upper") / chars,
        "open_lines": F.col("n_open_lines") / lines,
        "few_distinct": 1 - F.col("n_distinct") / n,
    }


def counts_of(raw: bytes) -> tuple[int, ...]:
    """COUNTS and MORE of one text.

    A repeated word stands in a window of WINDOW words that the text holds
    twice or more. Lines count if they hold a word; a line is a copy if it
    equals an earlier one, and open if it does not end in a full stop, an
    exclamation or a question mark.
    """
    words = raw.split()
    seen: set[bytes] = set()
    dup = open_ = 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    for x in lines:
        dup += x in seen
        seen.add(x)
        open_ += x.rstrip()[-1:] not in b".!?"
    windows = list(zip(*[words[k:] for k in range(WINDOW)]))
    many = Counter(windows)
    repeated = 0
    if len(many) < len(windows):
        edge = np.zeros(len(words) + 1, np.int64)
        at = np.flatnonzero(np.fromiter((many[x] > 1 for x in windows), bool, len(windows)))
        edge[at] += 1
        edge[at + WINDOW] -= 1
        repeated = int((np.cumsum(edge) > 0).sum())
    drop = lambda what: len(raw) - len(raw.translate(None, what))
    return (len(words), len(raw) - drop(_NO_CHARACTER), drop(_SYMBOLS), dup, repeated, len(lines), open_, drop(_UPPER), len(_LETTERED.findall(raw)), len(set(words)))


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """docs -> kept columns, COUNTS, MORE and text_hash of every whole text; null counts as empty.

    Every row gives one row; nothing is shuffled. A kept column with a
    result's name keeps it, and the result's name gets an underscore more.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(*kept_as(keep), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("_raw"))
    names = (*COUNTS, *MORE)

    def run(batches):
        for batch in batches:
            got = np.array([counts_of(x or b"") for x in batch.column("_raw").to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(got[:, k]) for k in range(len(names))]], names=[*batch.schema.names[:-1], *names])

    out = rows.mapInArrow(run, f"{kept_schema(rows, keep)}text_hash long, " + ", ".join(f"{n} long" for n in names))
    return named_back(out, keep, ("text_hash", *names))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """Chance of at most k among n, each with chance p: a sum of exact terms; 1 if k is no less than the expected number."""
    if k >= n * p:
        return 1.0
    i = np.arange(k, dtype=float)
    terms = n * np.log1p(-p) + np.concatenate(([0.0], np.cumsum(np.log((n - i) / (i + 1)) + np.log(p / (1 - p)))))
    top = terms.max()
    return float(min(1.0, np.exp(top) * np.exp(terms - top).sum()))


def tuned(tuning: DataFrame, levels: tuple[float, ...] = LEVELS, price: float = PRICE) -> DataFrame:
    """tuning(stratum, label, values) -> stratum, cuts: for each level an array with a cutoff for each rule, null for none.

    Values are counted in STEPS, so a stratum has at most STEPS + 1 counts a
    rule, whatever its size. At a level, a rule's cutoff is where the share of
    bad texts rejected less price times the share of good ones is largest,
    among cutoffs that reject at most that level of the good ones.
    """
    bins = tuning.select("stratum", "label", F.posexplode("values").alias("rule", "v")).groupBy("stratum", "rule", F.floor(F.col("v") * STEPS + 1e-9).cast("int").alias("cut"))
    bins = bins.agg(F.sum(F.col("label")).alias("good"), F.sum(1 - F.col("label")).alias("bad"))
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("cut"))
    whole = Window.partitionBy("stratum", "rule")
    share = lambda c: F.sum(c).over(above) / F.greatest(F.sum(c).over(whole), F.lit(1))
    rated = bins.select("stratum", "rule", "cut", share("good").alias("g"), share("bad").alias("b"))
    gain = F.col("b") - price * F.col("g")
    best = [F.max(F.when((F.col("g") <= x) & (gain > 0) & (F.col("cut") > 0), F.struct(gain.alias("gain"), "cut")))["cut"].alias(f"l{i}") for i, x in enumerate(levels)]
    per_rule = rated.groupBy("stratum", "rule").agg(*best)
    by_rule = lambda i: F.transform(F.array_sort(F.collect_list(F.struct("rule", F.col(f"l{i}").alias("cut")))), lambda x: x["cut"])
    return per_rule.groupBy("stratum").agg(F.array(*[by_rule(i) for i in range(len(levels))]).alias("cuts"))


def _fails(values: Column, cuts: Column) -> Column:
    """Whether a value reaches its rule's cutoff."""
    return F.exists(F.zip_with(values, cuts, lambda v, c: F.coalesce(F.floor(v * STEPS + 1e-9) >= c, F.lit(False))), lambda x: x)


def certified(holdout: DataFrame, cuts: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """holdout(stratum, label, values), cuts(stratum, cuts) -> stratum, level, cut (array), n_good, n_rejected, p_value of the level chosen for each stratum that has one.

    The null hypothesis of a level is that it rejects more than `risk` of the
    stratum's good texts; its p-value is the chance of so few rejected among
    the holdout's. Levels are tested from mild to strict until one is not
    refuted, each at error / strata: within a stratum the fixed order needs no
    further correction, between strata Bonferroni's holds for any dependence.
    So with chance 1 - error no stratum loses more than `risk`. Strata without
    a refuted level get no row.
    """
    good = holdout.where("label = 1").join(cuts, "stratum")
    first = F.array_position(F.transform("cuts", lambda c: _fails(F.col("values"), c)), True)  # from 1; 0: none rejects
    tally = good.groupBy("stratum", first.alias("first")).agg(F.count("*").alias("n"))
    tally = tally.groupBy("stratum").agg(F.collect_list(F.struct("first", "n")).alias("t"), F.sum("n").alias("n_good")).join(cuts, "stratum")
    strata = F.lit(max(1, cuts.count()))
    each = tally.select("stratum", "n_good", F.posexplode("cuts").alias("level", "cut"), "t")
    lost = F.aggregate(F.filter("t", lambda x: (x["first"] > 0) & (x["first"] <= F.col("level") + 1)), F.lit(0).cast("long"), lambda s, x: s + x["n"])

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(a), int(b), risk) for a, b in zip(k, n)], dtype=float)

    tested = each.select("stratum", "level", "cut", "n_good", lost.alias("n_rejected")).withColumn("p_value", tail("n_rejected", "n_good"))
    upto = Window.partitionBy("stratum").orderBy("level")
    passed = tested.withColumn("_ok", F.min((F.col("p_value") <= F.lit(error) / strata).cast("int")).over(upto)).where("_ok = 1")
    row = F.struct("level", "cut", "n_good", "n_rejected", "p_value")
    return passed.groupBy("stratum").agg(F.max_by(row, "level").alias("r")).select("stratum", "r.*")


def select_rules(measured: DataFrame, labels: DataFrame, label: str = "quality", **how) -> DataFrame:
    """measured(doc_id, stratum, text_hash, counts), labels(doc_id, label) -> cutoffs as `certified` gives them.

    All labelled texts that the base rules keep are used. Texts that are alike
    count once in their stratum, with their least label, and stand on one side:
    half of the texts tune the cutoffs, the other half tests them, by a hash of
    the text. Labels of no document, and null labels, count for nothing.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label"))
    rows = measured.where(~base_failed()).select("doc_id", "stratum", "text_hash", F.array(*rule_values().values()).alias("values"))
    rows = rows.join(F.broadcast(known) if small_enough(known, MOST_BROADCAST) else known, "doc_id")
    rows = rows.groupBy("stratum", "text_hash").agg(F.min("label").alias("label"), F.first("values").alias("values"))
    rows = written(rows.withColumn("tune", F.pmod(F.xxhash64(F.lit("half"), "text_hash"), F.lit(2)) == 0), "labelled")
    cuts = written(tuned(rows.where("tune"), **{k: v for k, v in how.items() if k in ("levels", "price")}), "cuts")
    return certified(rows.where("NOT tune"), cuts, **{k: v for k, v in how.items() if k in ("risk", "error")})


def judged(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """measured with base_failed and kept: no base rule fails and no certified cutoff of the stratum is reached; strata without cutoffs keep what the base rules keep."""
    few = cutoffs.select("stratum", "cut")
    rows = measured.join(F.broadcast(few) if small_enough(few, MOST_BROADCAST) else few, "stratum", "left")
    bad = F.coalesce(_fails(F.array(*rule_values().values()), F.col("cut")), F.lit(False))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~bad).drop("cut")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", label: str = "quality", **how) -> DataFrame:
    """docs(doc_id, text, stratum) -> doc_id, stratum, text_hash, COUNTS, MORE, base_failed, kept.

    Every row gives one row, repeated rows too. Null texts are empty and fail
    the base rules, as all texts of few words do; a null stratum is one of its
    own; rows without a doc_id have no label and are judged like others. Other
    columns are ignored, whatever their names; an empty table gives an empty
    one, and without labels only the base rules hold.
    """
    stratum = F.coalesce(F.concat(F.lit("s"), F.col(f"`{stratum_col}`").cast("string")), F.lit("n"))
    plain = docs.select("doc_id", stratum.alias("stratum"), F.col("text"))
    measured = written(measure(plain, ("doc_id", "stratum")), "measured")
    cutoffs = written(select_rules(measured, labels, label, **how), "cutoffs")
    return judged(measured, cutoffs)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept")
