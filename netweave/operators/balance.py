"""Synthetic rows for the smaller classes.

Neighbours are searched along several lines through the scaled features: rows next to
each other on a line are candidates, and the nearest of the candidates are taken. All lines
and classes are put in one order by range partitioning, in which every partition finds its
rows' candidates by itself, ``STRETCH`` rows at a time; only the few rows at the ends of
partitions are looked at again, beside those of the partitions next to theirs. So neither a
class nor a line is ever in one task, and work grows with the rows, not with pairs of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.constants import SMOTE_NEIGHBOURS, SPLIT_SEED
from netweave.functions.scalars import col_of, join_keys
from netweave.operators.prep import fit_scaler, ranked
from netweave.session import pinned, sweep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Lines, how many of them are on their way at once, and rows looked at in one go.
LINES, TURN = 6, 3
STRETCH = 20_000


def _lines(width: int, seed: int) -> np.ndarray:
    drawn = np.random.default_rng(seed).normal(size=(LINES, width))
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _gap(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def numbered(df: DataFrame, features: list[str], keys: list[str], label: str, others: list[str] | None = None) -> DataFrame:
    """The rows in the order of label and keys: label, keys, ``_f0``.. (the features), ``others``, ``_rank``,
    ``_id`` (rank of the first row of the same label and keys) and ``_me`` (of the first row equal in all).
    """
    named = [f"_f{i}" for i in range(len(features))]
    rows = df.select(col_of(label), *[col_of(k) for k in keys], *[col_of(c).cast("double").alias(n) for c, n in zip(features, named)],
                     *[col_of(c) for c in others or []])
    order = [label, *keys]
    return ranked(rows, [*order, *named], firsts={"_id": len(order), "_me": len(order) + len(named)})


def _best_of(rows: dict[str, np.ndarray], low: int, high: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances, whether they are null, and numbers (-1: none) of the closest of the ``most`` rows before and behind each row.

    ``rows`` are in order; null distances come first and those that aren't numbers last, as in Spark.
    """
    group, me, point, missing = (rows[k] for k in ("group", "me", "point", "missing"))
    here, shape = np.arange(low, high), (high - low, 2 * most)
    far, number, kind = np.zeros(shape), np.full(shape, -1, np.int64), np.full(shape, 2, np.int8)
    for i, step in enumerate([*range(-most, 0), *range(1, most + 1)]):
        there = here + step
        some = np.flatnonzero((there >= 0) & (there < len(me)))
        some = some[group[there[some]] == group[here[some]]]
        one, other = here[some], there[some]
        gap = np.zeros(len(some))
        with np.errstate(over="ignore", invalid="ignore"):
            for x in point:
                gap += (x[one] - x[other]) * (x[one] - x[other])
        null = missing[one] | missing[other]
        far[some, i], number[some, i], kind[some, i] = np.where(null, 0.0, gap), me[other], np.where(null, 0, 1)
    order = np.lexsort((number, far, kind), axis=-1)
    far, number, kind = (np.take_along_axis(v, order, axis=1) for v in (far, number, kind))
    keep = number >= 0
    keep[:, 1:] &= number[:, 1:] != number[:, :-1]
    at = np.cumsum(keep, axis=1) - 1
    row, column = np.nonzero(keep & (at < most))
    out = np.zeros((len(here), most)), np.zeros((len(here), most), bool), np.full((len(here), most), -1, np.int64)
    for to, v in zip(out, (far, kind == 0, number)):
        to[row, at[row, column]] = v[row, column]
    return out


def _offered(scaler: list[tuple[float, float]], most: int, stretch: int, names: list[str], kinds: list[pa.DataType]):
    """Rows (``_group``, ``_id``, ``_me``, ``_wanted``, features..) in order to the closest of the wanted ones, and the partition's ends."""
    def read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        null = np.array([c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns[4:]])
        known = [(c.astype(np.float64) - (np.nan if m is None else m)) / s for c, (m, s) in zip(columns[4:], scaler)]
        unknown = np.array([m is None for m, _ in scaler])[:, None]
        return {"group": columns[0], "id": columns[1], "me": columns[2], "wanted": columns[3].astype(bool),
                "raw": np.array(columns[4:], np.float64), "null": null, "point": np.array(known), "missing": (null | unknown).any(axis=0)}

    def cut(rows: dict[str, np.ndarray], low: int, high: int | None = None) -> dict[str, np.ndarray]:
        return {k: v[..., low:high] for k, v in rows.items()}

    def table(size: int, of: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([of[n].cast(k) if n in of else pa.nulls(size, k) for n, k in zip(names, kinds)], names)

    def closest_of(rows: dict[str, np.ndarray], low: int, high: int) -> pa.RecordBatch:
        far, null, number = _best_of(rows, low, high, most)
        some = rows["wanted"][low:high]
        of = {"_id": pa.array(rows["id"][low:high][some])}
        for i in range(most):
            none = number[some, i] < 0
            of |= {f"_d{i}": pa.array(far[some, i], mask=none | null[some, i]), f"_m{i}": pa.array(number[some, i], mask=none)}
        return table(int(some.sum()), of)

    def ends_of(rows: dict[str, np.ndarray], place: np.ndarray, number: int, total: int) -> pa.RecordBatch:
        of = {"_part": np.full(len(place), number), "_place": place, "_head": place < most, "_tail": place >= total - most,
              "_group": rows["group"], "_id": rows["id"], "_me": rows["me"], "_wanted": rows["wanted"]}
        raw = {f"_f{i}": pa.array(v, mask=n) for i, (v, n) in enumerate(zip(rows["raw"], rows["null"]))}
        return table(len(place), {k: pa.array(v) for k, v in of.items()} | raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, total, done, held, head = TaskContext.get().partitionId(), 0, 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            total += batch.num_rows
            new = read(batch)
            held = new if held is None else {k: np.concatenate([held[k], v], axis=-1) for k, v in new.items()}
            if head is None or len(head["me"]) < most:
                head = cut(held, 0, most)
            size = len(held["me"])
            if size - done >= stretch + most:
                for low in range(done, size - most, stretch):
                    yield closest_of(held, low, min(low + stretch, size - most))
                held, done = cut(held, max(0, size - 2 * most)), size - most - max(0, size - 2 * most)
        if held is not None:
            size = len(held["me"])
            yield closest_of(held, done, size)
            first = max(0, total - most)
            yield ends_of(cut(head, 0, min(most, first)), np.arange(min(most, first)), number, total)
            yield ends_of(cut(held, max(0, size - most)), np.arange(first, total), number, total)
    return run


def closest(rows: DataFrame, scaler: list[tuple[float, float]], label: str,
            neighbours: int = SMOTE_NEIGHBOURS, seed: int = SPLIT_SEED, wanted: Column | None = None) -> DataFrame:
    """``_id`` and ``_near``, the ``_me`` of the closest of ``numbered`` rows, the nearest first.

    Rows travel once per line, with numbers instead of keys and class, ``TURN`` lines at a time; each row keeps its
    closest on a line before lines are put together. ``wanted``: the rows to tell the closest of, the same for rows of one ``_id`` (all).
    """
    named = [f"_f{i}" for i in range(len(scaler))]

    def point(of) -> Column:
        return F.array(*[(of(n) - F.lit(m)) / F.lit(s) for n, (m, s) in zip(named, scaler)])

    axes = F.array(*[F.array(*[F.lit(float(w)) for w in line]) for line in _lines(len(named), seed)])
    # One row per class.
    classes = rows.select(col_of(label)).distinct().withColumn("_class", F.row_number().over(Window.orderBy(col_of(label))))
    rows = join_keys(rows.withColumn("_wanted", F.lit(True) if wanted is None else wanted), F.broadcast(classes), [label])
    rows = rows.select("_class", "_id", "_me", "_wanted", *named)
    order = [F.col(c).asc_nulls_first() for c in ("_group", "_at", "_id", "_me")]
    told = [f"_{k}{i}" for i in range(neighbours) for k in ("d", "m")]
    kinds = {"_part": "int", "_place": "long", "_head": "boolean", "_tail": "boolean", "_group": "int", "_id": "long", "_me": "long", "_wanted": "boolean",
             **{n: "double" for n in named}, **{c: "double" if c[1] == "d" else "long" for c in told}}
    arrow = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    run = _offered(scaler, neighbours, STRETCH, list(kinds), [arrow[k] for k in kinds.values()])
    across = Window.orderBy("_part", "_place")
    row = F.struct("_group", "_me", *named)
    offers = F.array(*[F.when(F.col(end), f(row, step).over(across))
                       for step in range(1, neighbours + 1) for end, f in (("_head", F.lag), ("_tail", F.lead))])
    alike = F.filter("_offers", lambda o: o["_group"] == F.col("_group"))
    gaps = F.transform(alike, lambda o: F.struct(_gap(F.col("_point"), point(lambda n: o[n])).alias("d"), o["_me"].alias("m")))
    found = []
    for low in range(0, LINES, TURN):
        sweep(rows.sparkSession)
        lines = rows.withColumn("_line", F.explode(F.sequence(F.lit(low), F.lit(min(low + TURN, LINES) - 1))))
        lines = lines.select((F.col("_class") * LINES + F.col("_line")).alias("_group"), "_id", "_me", "_wanted", *named,
                             _dot(point(F.col), F.get(axes, F.col("_line"))).alias("_at"))
        placed = lines.repartitionByRange(*order).sortWithinPartitions(*order).drop("_at")
        offered = pinned(placed.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items())), "offered")
        # At most ``2 * neighbours`` rows per partition.
        ends = offered.where(F.col("_part").isNotNull()).withColumn("_offers", offers).where("_wanted")
        ends = ends.withColumn("_point", point(F.col)).select("_id", F.slice(F.sort_array(F.array_distinct(gaps)), 1, neighbours).alias("_best"))
        ends = ends.select("_id", *[F.get("_best", i)[k].alias(f"_{k}{i}") for i in range(neighbours) for k in ("d", "m")])
        found += [offered.where(F.col("_part").isNull()).select("_id", *told), ends]
    del lines, placed
    sweep(rows.sparkSession)
    best = reduce(DataFrame.unionByName, found).repartition("_id")
    each = F.filter(F.array(*[F.struct(F.col(f"_d{i}").alias("d"), F.col(f"_m{i}").alias("m")) for i in range(neighbours)]), lambda o: o["m"].isNotNull())
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list(each))))
    return best.groupBy("_id").agg(F.slice(merged, 1, neighbours).alias("_near")).select("_id", F.col("_near.m").alias("_near"))


def nearest(df: DataFrame, features: list[str], keys: list[str], label: str,
            neighbours: int = SMOTE_NEIGHBOURS, seed: int = SPLIT_SEED) -> DataFrame:
    """label, keys, ``near``: the closest rows' features of the same class among the candidates.

    ``df`` must be deterministic; keys tell rows apart. Distances are between scaled features.
    """
    scaler = fit_scaler(df, features)
    rows = numbered(df, features, keys, label)
    found = closest(rows, [scaler[c] for c in features], label, neighbours, seed)
    points = rows.where(F.col("_rank") == F.col("_me")).select(F.col("_me").alias("_of"), F.array(*[f"_f{i}" for i in range(len(features))]).alias("_raw"))
    each = found.select("_id", F.posexplode_outer("_near").alias("_place", "_of")).join(points, "_of", "left").groupBy("_id").agg(
        F.sort_array(F.collect_list(F.struct("_place", "_raw"))).alias("_all"))
    named = rows.where(F.col("_rank") == F.col("_id")).select("_id", col_of(label), *[col_of(k) for k in keys]).join(each, "_id")
    near = F.transform(F.filter("_all", lambda s: s["_raw"].isNotNull()), lambda s: s["_raw"])
    return named.select(col_of(label), *[col_of(k) for k in keys], near.alias("near")).where(F.size("near") > 0)


def smote(df: DataFrame, features: list[str], keys: list[str], label: str = "label_id",
          neighbours: int = SMOTE_NEIGHBOURS, seed: int = SPLIT_SEED) -> DataFrame:
    """Rows of all classes, the smaller ones filled up to the largest.

    A synthetic row lies between a row and one of its neighbours of the same class; a row
    without any is copied. Columns: the features, the label and ``is_synthetic``.
    """
    given = df.select(*[col_of(c).cast("double").alias(c) for c in features], col_of(label),
                      F.lit(False).alias("is_synthetic"))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    # One row per class.
    sizes = sizes.withColumn("_lack", F.max("_n").over(Window.partitionBy(F.lit(1))) - F.col("_n"))
    small = join_keys(df, F.broadcast(sizes.where(F.col("_lack") > 0)), [label])
    scaler = fit_scaler(small, features)
    rows = numbered(small, features, keys, label, ["_n", "_lack"])
    first = rows.groupBy(label).agg(F.min("_rank").alias("_first"))
    based = join_keys(rows, F.broadcast(first), [label])

    def copies(rank: str) -> Column:
        number = F.col(rank) - F.col("_first")
        return F.floor(F.col("_lack") / F.col("_n")) + F.when(number < F.col("_lack") % F.col("_n"), 1).otherwise(0)

    # The first row of a class's keys has the most copies.
    near = closest(based, [scaler[c] for c in features], label, neighbours, seed, copies("_id") > 0)
    based = based.withColumn("_copies", copies("_rank")).where(F.col("_copies") > 0).join(near, "_id", "left")
    based = based.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    drawn = F.xxhash64(F.lit(seed), *[col_of(k) for k in keys], F.col("_copy"))
    some = F.coalesce(F.size("_near"), F.lit(0)) > 0
    # A row without any is its own neighbour.
    chosen = F.when(some, F.get("_near", F.pmod(drawn, F.size("_near").cast("long")).cast("int"))).otherwise(F.col("_me"))
    part = F.pmod(F.xxhash64(F.lit(seed + 1), *[col_of(k) for k in keys], F.col("_copy")), F.lit(1_000_000)) / 1e6
    named = [f"_f{i}" for i in range(len(features))]
    based = based.select(col_of(label), *named, chosen.alias("_of"), part.alias("_part"))
    points = rows.where(F.col("_rank") == F.col("_me")).select(F.col("_me").alias("_of"), *[F.col(n).alias(f"{n}_near") for n in named])
    mixed = based.join(points, "_of")
    made = mixed.select(
        *[(F.col(n) + (F.col(f"{n}_near") - F.col(n)) * F.col("_part")).alias(c) for n, c in zip(named, features)],
        col_of(label), F.lit(True).alias("is_synthetic"))
    return given.unionByName(made)
