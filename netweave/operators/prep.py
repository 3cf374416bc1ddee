"""Samples, label ids, exact stratified splits, scaling, weights, balancing."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.constants import (
    CLASS_WEIGHTS, LABEL_IDS, TEST_SHARE, VALIDATION_SHARE,
)
from netweave.functions.scalars import col_of, join_keys
from netweave.operators.clean import finite_features
from netweave.session import pinned


# --- samples -------------------------------------------------------------------

def ranked(df: DataFrame, order: list[str], keep: list[str] | None = None, firsts: dict[str, int] | None = None) -> DataFrame:
    """``df`` with ``_rank`` (0, 1, ..) in the given order, nulls first, compared in their own types.

    Rows are range-partitioned and sorted once and written; a row's rank is its place in
    its partition after the sizes of the partitions before. Those sizes are one row per
    partition. ``keep``: the columns to go on with. ``firsts``: columns to add, each the rank of
    the first row that is equal in so many of the order's columns.
    """
    keep, firsts = df.columns if keep is None else keep, firsts or {}
    columns = [col_of(c).asc_nulls_first() for c in order]
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*columns[:min(firsts.values(), default=len(order))]).sortWithinPartitions(*columns)
    if firsts:
        # Equal rows are in one partition already, so that these windows shuffle nothing.
        placed = placed.withColumn("_pos", at).select(*[col_of(c) for c in keep], "_pos", *[
            F.min("_pos").over(Window.partitionBy(*[col_of(c) for c in order[:n]])).alias(name) for name, n in firsts.items()])
        at = F.col("_pos")
    first_of = [(F.col(name).bitwiseAND((1 << 33) - 1) - at.bitwiseAND((1 << 33) - 1)).alias(name) for name in firsts]
    placed = placed.select(
        *[col_of(c) for c in keep], F.shiftright(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_place"), *first_of)
    placed = pinned(placed, "ranked")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = placed.join(F.broadcast(before), F.col("_part") == F.col("_of"))
    rank = F.col("_before") + F.col("_place")
    return out.select(*[col_of(c) for c in keep], rank.alias("_rank"), *[(rank + F.col(name)).alias(name) for name in firsts])


def head_sample(df: DataFrame, order: list[str], share: float, total: int | None = None) -> DataFrame:
    """The first ``int(total * share)`` rows in the given order."""
    placed = ranked(df, order)
    total = placed.count() if total is None else total
    return placed.where(F.col("_rank") < int(total * share)).drop("_rank")


def class_coverage(df: DataFrame, order: list[str], label: str = "label", share: float = 0.1,
                   wider: float = 0.2, classes: int = 4) -> DataFrame:
    """The sample with enough classes: the small one, or else the wider one, described.

    Both samples come from the classes' first ranks and counts in one pass.
    """
    placed = ranked(df, order)
    total = placed.count()
    sizes = {s: int(total * s) for s in (share, wider)}
    within = {s: F.col("_rank") < n for s, n in sizes.items()}
    found = placed.agg(*[
        f(F.when(within[s], value)).alias(f"{name}_{i}")
        for i, s in enumerate((share, wider))
        for name, f, value in (("rows", F.count, F.lit(1)), ("classes", F.count_distinct, col_of(label)))
    ])
    small, wide = (
        F.struct(F.lit(s).alias("share"), F.col(f"rows_{i}").alias("row_count"), F.col(f"classes_{i}").alias("class_count"))
        for i, s in enumerate((share, wider))
    )
    return found.select(F.when(F.col("classes_0") >= classes, small).otherwise(wide).alias("s")).select("s.*")


# --- labels --------------------------------------------------------------------

#: A mapping of at most this many ids is sent to every executor.
FEW_IDS = 10_000


def _mapped(key: Column, mapping: dict) -> Column:
    entries = [F.lit(v) for pair in mapping.items() for v in pair]
    return F.element_at(F.create_map(*entries), key)


def encode_labels(df: DataFrame, ids: dict[str, int] = LABEL_IDS, label: str = "label") -> DataFrame:
    """``label_id`` from the label's text; a label without an id stops the job."""
    found = F.try_element_at(F.create_map(*[F.lit(v) for p in ids.items() for v in p]), col_of(label))
    return df.withColumn(
        "label_id",
        F.coalesce(found, F.raise_error(F.concat(F.lit("no id for label: "), F.coalesce(col_of(label), F.lit("null")))).cast("int")),
    )


def decode_labels(df: DataFrame, ids: dict[str, int] = LABEL_IDS, column: str = "label_id") -> DataFrame:
    return df.withColumn("label", _mapped(col_of(column).cast("int"), {v: k for k, v in ids.items()}))


def remap_labels(df: DataFrame, column: str = "label_id") -> DataFrame:
    """Close gaps in the label ids: ``remapped`` is 0, 1, .. in the order of the old ids.

    A row without an id keeps none. The mapping has one row per class.
    """
    present = df.select(column).where(col_of(column).isNotNull()).distinct()
    mapping = present.withColumn("remapped", (F.dense_rank().over(Window.orderBy(column)) - 1).cast("int"))
    # A shuffle by so few ids would put a class into one task; many ids are spread by it.
    few = present.limit(FEW_IDS + 1).count() <= FEW_IDS
    return df.join(F.broadcast(mapping) if few else mapping, column, "left")


# --- exact stratified split --------------------------------------------------------

def split_thresholds(df: DataFrame, label: str, key: str, ties: list[str],
                     test: float = TEST_SHARE, validation: float = VALIDATION_SHARE) -> DataFrame:
    """Per class the rows at which the test and the validation part end.

    Rows of a class are ordered by ``key`` (a whole number spread evenly, with far
    fewer values than rows) and ``ties``. Counting rows per class and key value
    combines before it shuffles. Only rows of the key values at the two borders are
    then put in order.
    """
    counted = df.groupBy(col_of(label).alias("_label"), F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    running = Window.partitionBy("_label").orderBy("_key")
    whole = Window.partitionBy("_label")
    counted = counted.withColumns({
        "_upto": F.sum("_n").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "_all": F.sum("_n").over(whole),
    })
    test_size = F.ceil(F.col("_all") * F.lit(test)).cast("long")
    rest = F.col("_all") - test_size
    val_size = F.ceil(rest * F.lit(validation / (1 - test))).cast("long")
    sized = counted.withColumn("_cut", F.explode(F.array(
        F.struct(F.lit("test").alias("name"), test_size.alias("size")),
        F.struct(F.lit("val").alias("name"), (test_size + val_size).alias("size")),
    )))
    before = F.col("_upto") - F.col("_n")
    # Two rows per class.
    borders = sized.where((F.col("_upto") >= F.col("_cut.size")) & (before < F.col("_cut.size"))).select(
        "_label", "_key", (F.col("_cut.size") - before).alias("_at"), F.col("_cut.name").alias("_name"))
    near = df.select(col_of(label).alias("_label"), F.col(key).alias("_key"), *ties)
    near = join_keys(near, F.broadcast(borders), ["_label", "_key"])
    nth = F.row_number().over(Window.partitionBy("_label", "_name").orderBy(*ties))
    row = F.struct(F.col("_key"), *ties)
    return near.withColumn("_nth", nth).where(F.col("_nth") == F.col("_at")).groupBy("_label").agg(*[
        F.max(F.when(F.col("_name") == name, row)).alias(f"_{name}_end") for name in ("test", "val")
    ])


def stratified_split(df: DataFrame, label: str, key: str, ties: list[str],
                     test: float = TEST_SHARE, validation: float = VALIDATION_SHARE, ends: DataFrame | None = None) -> DataFrame:
    """Add ``part``: test, validation or train, with the same shares in every class.

    Rows without a label are a class of their own. ``ends``: the table's ``split_thresholds``.
    """
    ends = split_thresholds(df, label, key, ties, test, validation) if ends is None else ends
    here = F.struct(F.col(key).alias("_key"), *ties)
    joined = df.join(F.broadcast(ends), col_of(label).eqNullSafe(F.col("_label")))
    part = (
        F.when(here <= F.col("_test_end"), "test")
        .when(here <= F.col("_val_end"), "validation")
        .otherwise("train")
    )
    return joined.withColumn("part", part).drop("_label", "_test_end", "_val_end")


# --- scaling and weights ---------------------------------------------------------------

def fit_scaler(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a deviation of 0 counts as 1. One pass."""
    found = train.agg(*[
        f(col_of(c)).alias(f"_{i}_{j}") for i, c in enumerate(columns) for j, f in enumerate((F.avg, F.stddev_pop))
    ]).first()
    return {c: (found[2 * i], found[2 * i + 1] or 1.0) for i, c in enumerate(columns)}


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (col_of(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


def with_weight(df: DataFrame, weights: dict[int, float] = CLASS_WEIGHTS, column: str = "label_id") -> DataFrame:
    return df.withColumn("weight", _mapped(col_of(column), weights))


def class_weights(df: DataFrame, column: str = "label_id", weights: dict[int, float] = CLASS_WEIGHTS) -> DataFrame:
    """Per class its rows, its fixed weight and the weight its share calls for."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    most = counted.agg(F.max("row_count").alias("_most"))
    return with_weight(counted, weights, column).join(F.broadcast(most), F.lit(True)).select(
        column, "row_count", "weight", F.round(F.col("_most") / F.col("row_count"), 4).alias("balanced_weight")
    )


def feature_vector(df: DataFrame, features: list[str], output: str = "features") -> DataFrame:
    """Ordered vector of the features; non-finite values count as 0."""
    return VectorAssembler(inputCols=features, outputCol=output).transform(finite_features(df, features))
