"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

Each rule is a value of a document in thousandths; a document whose value lies above the
cutoff is rejected. Cutoffs are chosen per stratum (language) on labelled documents. For
``n`` good ones, the exact binomial distribution tells how many ``k`` may be rejected so
that a true rate of ``ALPHA`` divided by the number of rules would show ``k`` or fewer with
a chance of at most ``DELTA`` divided by rules times strata (Bonferroni). Cutoffs are
tested from the loosest to the strictest, so every cutoff with at most ``k`` rejections
holds at once, and any of them may be taken: the one with the most labelled bad documents
above it, less ``PRICE`` for each good one; the loosest of equals. A stratum with too few
labels for any guarantee gets no cutoff, and its documents are kept.

Defined cases: a null text has no words, so it fails the base rule; a null language is a
stratum of its own; a document is good if all its labels say 1, bad if any says 0, and
labels without a document or a value count for nothing; repeated rows are judged alike;
empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.llm.common import BLANKS, words

ALPHA, DELTA, PRICE = 0.01, 0.05, 10
RULES = ("symbols", "dup_lines", "repeats", "word_length")


def stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """Counts per document and the rules' values; nothing is shuffled.

    Words in repeated three-word windows: the windows' hashes are sorted with their places,
    equal neighbours are the repeated ones, and the places they cover are counted once.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda line: F.trim(line, F.lit(BLANKS)) != "")
    rows = docs.select(*keep, words(body).alias("w"), lines.alias("lines"), F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    none = F.array().cast("array<bigint>")
    triples = F.transform(F.slice("w", F.lit(1), F.size("w") - 2), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    rows = rows.withColumn("h", F.when(F.size("w") >= 3, triples).otherwise(none))
    places = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("p", F.when(F.size(F.array_distinct("h")) < F.size("h"), places).otherwise(empty))
    twice = F.filter("p", lambda x, i: (x["h"] == F.get("p", i - 1)["h"]) | (x["h"] == F.get("p", i + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    rows = rows.select(
        *keep, F.size("w").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))

    def share(a: str, b: str, times: int) -> Column:
        return F.when(F.col(b) > 0, F.least(F.lit(1000), F.floor(times * F.col(a) / F.col(b)))).otherwise(F.lit(0)).cast("long")

    return rows.select(
        "*", failed.alias("base_failed"), share("n_symbols", "word_chars", 1000).alias("symbols"),
        share("n_dup_lines", "n_lines", 1000).alias("dup_lines"), share("n_repeat_words", "n_words", 1000).alias("repeats"),
        share("word_chars", "n_words", 10).alias("word_length"),
    )


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function by Stirling's series, for large arguments."""
    return (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x)


def allowed(n: Column, rate: float, risk: float | Column) -> Column:
    """The largest k with P(Binomial(n, rate) <= k) <= risk, or -1.

    Terms are summed upwards. Below twelve deviations under the mean they add nothing that
    a double holds, so large samples start there; the number of terms grows with the root.
    """
    import math

    n = n.cast("double")
    mean = n * rate
    low = F.greatest(F.lit(0.0), F.floor(mean - 12 * F.sqrt(mean) - 100).cast("double"))
    odds = math.log(rate) - math.log1p(-rate)
    first = F.when(low == 0, n * math.log1p(-rate)).otherwise(
        _log_gamma(n + 1) - _log_gamma(low + 1) - _log_gamma(n - low + 1) + low * math.log(rate) + (n - low) * math.log1p(-rate))
    start = F.struct(first.alias("term"), F.lit(0.0).alias("sum"), (low - 1).alias("k"))

    def step(s: Column, j: Column) -> Column:
        total = s["sum"] + F.exp(s["term"])
        grown = s["term"] + F.log((n - j) / (j + 1)) + odds
        return F.struct(grown.alias("term"), total.alias("sum"), F.when(total <= risk, j).otherwise(s["k"]).alias("k"))

    last = F.aggregate(F.sequence(low.cast("long"), F.ceil(mean).cast("long")).cast("array<double>"), start, step)
    return last["k"].cast("long")


def cutoffs(judged: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA,
            price: int = PRICE) -> DataFrame:
    """One row per stratum and rule with a cutoff: stratum, rule, cutoff.

    Labelled documents shrink to counts per stratum, rule and value before any window;
    a window holds at most 1001 rows.
    """
    by_doc = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    held = judged.where(~F.col("base_failed")).join(by_doc, "doc_id")
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES]))
    counts = (held.select(F.col(stratum).alias("stratum"), "good", values.alias("v"))
              .groupBy("stratum", F.col("v.rule").alias("rule"), F.col("v.value").alias("value"))
              .agg(F.sum((F.col("good") == 1).cast("long")).alias("good"), F.sum((F.col("good") != 1).cast("long")).alias("bad")))
    whole = Window.partitionBy("stratum", "rule")
    above = whole.orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    strata = counts.where("good > 0").select("stratum").distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("strata"))
    tested = counts.select(
        "*", F.sum("good").over(whole).alias("n"), F.coalesce(F.sum("good").over(above), zero).alias("lost"),
        F.coalesce(F.sum("bad").over(above), zero).alias("caught"),
    ).crossJoin(F.broadcast(strata))
    most = tested.groupBy("stratum", "rule").agg(F.max("n").alias("n"), F.max("strata").alias("strata"))
    most = most.select("stratum", "rule", allowed(F.col("n"), alpha / len(RULES), delta / (len(RULES) * F.col("strata"))).alias("k"))
    most = most.select(F.col("stratum").alias("s"), F.col("rule").alias("r"), "k")
    fits = tested.join(most, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("rule") == F.col("r"))).where("lost <= k")
    best = F.max(F.struct((F.col("caught") - price * F.col("lost")).alias("gain"), "value"))
    return fits.groupBy("stratum", "rule").agg(best["value"].alias("cutoff"))


def judge(judged: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """``judged`` with ``kept``."""
    wide = cuts.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES])
    both = judged.join(wide.withColumnRenamed("stratum", "_stratum"), F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    broken = F.col("base_failed")
    for r in RULES:
        broken = broken | F.coalesce(F.col(r) > F.col(f"_cut_{r}"), F.lit(False))
    return both.select(*judged.columns, (~broken).alias("kept"))
