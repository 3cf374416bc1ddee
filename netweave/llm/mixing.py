"""Mix sources to target weights by repeating documents.

Words are summed per source, targets follow from weights and caps, and a source's
repetition rate is its target over its size. A document is emitted ``floor(rate)``
times, and once more when a number derived from its id falls below the fraction.

Defined cases: a null text has 0 words; a null source is a source of its own and comes
last; a source without words gets target 0 and rate 0; rows that share id and source
share the draw; an empty table gives an empty result. Only the columns named by the
arguments are read, others pass through ``mix`` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.llm.common import saved, word_count


def sizes(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
    )


def targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target: ``share`` of all words, dealt by weight, at most ``cap`` times a source.

    Weights repeat along the sources in code-point order. With the sources in order of
    size over weight, the capped ones come first; the level at which the others stand is
    the largest of ``(goal - caps before) / (weights from here on)``. The windows run over
    one pre-summed row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place - 1) % len(weights) + 1)
    per = per.withColumn("place", place).withColumn("weight", weight)
    upward = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    onward = upward.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = upward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    goal = F.lit(float(share)) * F.sum("source_size").over(everything)
    capped = F.lit(float(cap)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    per = per.withColumn("level", (goal - capped) / F.sum("weight").over(onward))
    level = F.max("level").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.lit(float(cap)) * F.col("source_size"), F.col("weight") * level)
    return per.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, source: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the seed, the id and the source alone."""
    none = F.lit("")
    told = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), none), F.coalesce(source, none))
    return F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def copies(sized: DataFrame, goals: DataFrame, seed: str = "mix") -> DataFrame:
    """``sized`` with source_size, target and the number of copies of each document."""
    found = sized.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (draw(F.col("d.doc_id"), F.col("d.source"), seed) < rate - whole).cast("long")
    return found.select("d.*", "source_size", "target", (whole + extra).alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
        seed: str = "mix", text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    goals = targets(sizes(docs, text, source, doc_id), weights, share, cap)
    rates = goals.select(
        F.col("source").alias("_mix_source"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_mix_rate"),
    )
    joined = docs.join(rates, F.col(source).eqNullSafe(F.col("_mix_source")))
    whole = F.floor("_mix_rate")
    extra = (draw(F.col(doc_id), F.col(source), seed) < F.col("_mix_rate") - whole).cast("long")
    often = F.explode(F.array_repeat(F.lit(0), (whole + extra).cast("int"))).alias("_mix_copy")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], often).drop("_mix_copy")
