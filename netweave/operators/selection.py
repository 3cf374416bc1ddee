"""Which features tell the classes apart: scores, their blend, the final choice."""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave.constants import (
    COMPARED_COUNT, CORRELATION_LIMIT, CRITICAL_FEATURES, METHOD_WEIGHTS, SELECTED_COUNT,
)
from netweave.functions.quantiles import exact_quantiles, long_values, with_bounds_below
from netweave.functions.scalars import col_of


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of every pair of complete columns.

    One pass finds the means, one sums the products of what is left after taking
    the means off. ``feature2`` comes before ``feature1`` in the list of features.
    """
    means = df.agg(*[F.avg(col_of(c)).alias(f"_{i}") for i, c in enumerate(features)]).first()
    off = df.select(*[
        (col_of(c).cast("double") - F.lit(m)).alias(f"_{i}") for i, (c, m) in enumerate(zip(features, means))
    ])
    pairs = list(combinations(range(len(features)), 2))
    sums = off.agg(*[
        F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"_{i}_{j}")
        for i, j in [*((i, i) for i in range(len(features))), *pairs]
    ])
    return sums.select(F.inline(F.array(*[
        F.struct(
            F.lit(features[j]).alias("feature1"), F.lit(features[i]).alias("feature2"),
            F.try_divide(F.col(f"_{i}_{j}"), F.sqrt(F.col(f"_{i}_{i}")) * F.sqrt(F.col(f"_{j}_{j}"))).alias("correlation"),
        )
        for i, j in pairs
    ])))


def correlated_pairs(df: DataFrame, features: list[str], limit: float = CORRELATION_LIMIT) -> DataFrame:
    """Pairs whose absolute correlation is above the limit."""
    size = F.abs(F.col("correlation"))
    return correlations(df, features).where(~F.isnan("correlation") & (size > limit)).select(
        "feature1", "feature2", size.alias("correlation")
    )


def redundant_features(pairs: DataFrame) -> DataFrame:
    """The earlier feature of every correlated pair, once."""
    return pairs.select(F.col("feature2").alias("feature")).distinct()


def anova_f(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """F value per feature: spread between the classes over spread within them."""
    per_class = df.groupBy(col_of(label)).agg(F.array(*[
        F.struct(
            F.lit(c).alias("feature"), F.count(col_of(c)).alias("n"),
            F.avg(col_of(c)).alias("mean"), F.var_pop(col_of(c)).alias("spread"),
        )
        for c in features
    ]).alias("_rows")).select(F.inline("_rows"))
    by = Window.partitionBy("feature")
    grand = F.sum(F.col("mean") * F.col("n")).over(by) / F.sum("n").over(by)
    sums = per_class.withColumn("_off", F.col("mean") - grand).groupBy("feature").agg(
        F.sum(F.col("n") * F.col("_off") * F.col("_off")).alias("between"),
        F.sum(F.col("n") * F.col("spread")).alias("within"),
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("rows"),
    )
    return sums.select(
        "feature",
        F.try_divide(
            F.try_divide(F.col("between"), F.col("k") - 1),
            F.try_divide(F.col("within"), F.col("rows") - F.col("k")),
        ).alias("f_score"),
    )


def quantile_cuts(df: DataFrame, features: list[str], bins: int = 20) -> dict[str, list[float]]:
    shares = [Fraction(i, bins) for i in range(1, bins)]
    return exact_quantiles(df, {c: col_of(c) for c in features}, shares)


def mutual_information(df: DataFrame, features: list[str], label: str = "label", bins: int = 20,
                       cuts: dict[str, list[float]] | None = None) -> DataFrame:
    """Mutual information with the class, over bins of about equal size, in nats.

    A value's bin is the number of cut points below it.
    """
    cuts = cuts or quantile_cuts(df, features, bins)
    labelled = df.withColumn("label", col_of(label))
    rows = long_values(labelled, {i: col_of(c).cast("double") for i, c in enumerate(features)}, ("label",))
    binned = with_bounds_below(rows, [sorted(set(cuts[c])) for c in features], "bin")
    names = F.array(*[F.lit(c) for c in features])
    cells = binned.groupBy("c", "bin", "label").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("feature", F.get(names, "c"))
    total = F.sum("n").over(Window.partitionBy("feature"))
    of_bin = F.sum("n").over(Window.partitionBy("feature", "bin"))
    of_label = F.sum("n").over(Window.partitionBy("feature", "label"))
    cells = cells.withColumns({"_all": total, "_bin": of_bin, "_label": of_label})
    n = F.col("n").cast("double")
    part = n / F.col("_all") * F.log(n * F.col("_all") / (F.col("_bin").cast("double") * F.col("_label")))
    return cells.groupBy("feature").agg(F.sum(part).alias("mi_score"))


def long_scores(tables: dict[str, DataFrame]) -> DataFrame:
    """Method tables of (feature, score) as one table of (method, feature, score)."""
    out = None
    for method, scores in tables.items():
        value = [c for c in scores.columns if c != "feature"][0]
        part = scores.select(F.lit(method).alias("method"), "feature", F.col(value).cast("double").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def blend_scores(scores: DataFrame, methods: list[str],
                 weights: dict[str, float] = METHOD_WEIGHTS) -> DataFrame:
    """Weighted sum of the methods' scores, each brought to the range 0 to 1.

    A method whose scores are all equal keeps them as they are. Only features
    scored by every method count. The table has one row per method and feature.
    """
    used = [m for m in methods if m in weights]
    by = Window.partitionBy("method")
    low, high = F.min("score").over(by), F.max("score").over(by)
    normal = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.col("score"))
    weight = F.element_at(F.create_map(*[F.lit(v) for m in used for v in (m, weights[m])]), F.col("method"))
    parts = scores.where(F.col("method").isin(used)).withColumn("_part", normal).withColumn("_part", F.col("_part") * weight)
    return (
        parts.groupBy("feature")
        .agg(
            *[F.max(F.when(F.col("method") == m, F.col("_part"))).alias(f"score_{m}") for m in used],
            F.count(F.lit(1)).alias("_methods"),
        )
        .where(F.col("_methods") == len(used))
        .select("feature", *[f"score_{m}" for m in used],
                sum((F.col(f"score_{m}") for m in used[1:]), F.col(f"score_{used[0]}")).alias("final_score"))
    )


def select_top(blended: DataFrame, count: int = SELECTED_COUNT, critical=CRITICAL_FEATURES,
               preserve_all: bool = False) -> DataFrame:
    """The best features by position, with critical ones forced in.

    Every missing critical feature takes the last place from whatever holds it, so
    only the last of them stays. With ``preserve_all`` each takes a place of its own
    from the end. The table has one row per feature.
    """
    place = F.row_number().over(Window.orderBy(F.desc("final_score"), "feature"))
    ranked = blended.select("feature", place.alias("position"))
    wanted = F.array(*[F.lit(c) for c in critical])
    ordinal = F.array_position(wanted, F.col("feature")).cast("int")
    if not preserve_all:
        inside = ranked.where(F.col("position") < count)
        rest = ranked.where(F.col("position") >= count)
        last = rest.select("feature", F.lit(count).alias("position"),
                           F.row_number().over(Window.orderBy(F.desc(ordinal), "position")).alias("_n"))
        return inside.unionByName(last.where(F.col("_n") == 1).drop("_n"))
    first = F.when((ordinal > 0) | (F.col("position") <= count), 1).otherwise(0)
    forced = F.row_number().over(Window.orderBy(F.desc(F.when(ordinal > 0, 1).otherwise(0)), "position"))
    kept = ranked.where(first == 1).withColumn("_turn", forced).where(F.col("_turn") <= count)
    return kept.select("feature", F.row_number().over(Window.orderBy("position")).alias("position"))


def method_matrix(scores: DataFrame, blended: DataFrame, methods: list[str],
                  count: int = COMPARED_COUNT) -> DataFrame:
    """Per leading feature the score of each method as a share of the method's best."""
    best = F.max("score").over(Window.partitionBy("method"))
    shares = scores.withColumn("_best", best).withColumn(
        "_share", F.when(F.col("_best") > 0, F.col("score") / F.col("_best")).otherwise(0.0)
    )
    leading = blended.orderBy(F.desc("final_score"), "feature").limit(count).select("feature")
    return (
        shares.join(F.broadcast(leading), "feature")
        .groupBy("feature")
        .agg(*[
            F.coalesce(F.max(F.when(F.col("method") == m, F.col("_share"))), F.lit(0.0)).alias(m)
            for m in methods
        ])
    )
