"""Time-window duplicate suppression per key.

A row is kept when its key has no kept row less than ``window_us`` before it. That
rule walks through a key's rows in order, but a key may hold a large share of all
rows, so no task may walk through a whole key. Instead:

* a key's time is cut into blocks of ``BLOCK_WINDOWS`` windows. What a block does
  to the walk is a step function from "earliest time that may be kept" to "last
  kept time", and is worked out for each block alone;
* step functions of up to ``FAN`` neighbouring blocks are chained into one, level by
  level, until few are left per key;
* the walk then runs through those, and back down, so that each block learns the
  last kept time before it, and picks its kept rows.

Blocks are shuffled by key and block, so a hot key is spread over the cluster. The
Python part sees arrays of times only.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.constants import DEDUP_WINDOW_US
from netweave.functions.scalars import join_keys

BLOCK_WINDOWS = 8
FAN = 32
_NEVER = np.iinfo(np.int64).min // 2

# The functions below travel to the executors whole; the package need not be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- step functions over arrays of times -------------------------------------

def _block_steps(times: np.ndarray, start: int, window: int, whole: bool = False):
    """For every earliest allowed time below ``start + window``: the last kept time.

    A state carried from before these rows may lie inside any block; ``whole`` takes all
    earliest times for it.
    """
    n = len(times)
    following = np.searchsorted(times, times + window)
    last = np.where(following < n, following, np.arange(n))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    entries = n if whole else min(n, int(np.searchsorted(times, start + window)) + 1)
    return _compact(times[:entries], times[last[:entries]])


def _compact(limits: np.ndarray, results: np.ndarray):
    """Drop steps that lead to the same result as the next one."""
    keep = np.ones(len(results), dtype=bool)
    keep[:-1] = results[1:] != results[:-1]
    return limits[keep], results[keep]


def _advance(last_kept: np.ndarray, steps, window: int) -> np.ndarray:
    limits, results = steps
    at = np.searchsorted(limits, last_kept + window)
    return np.where(at < len(limits), results[np.minimum(at, len(limits) - 1)], last_kept)


def _chain_steps(parts: list, window: int, whole: bool = False):
    """The step function of several neighbouring blocks, in time order."""
    if whole:
        ends = [results for _, results in parts]
        for i, steps in enumerate(parts):
            ends[:i] = [_advance(e, steps, window) for e in ends[:i]]
        return _compact(np.concatenate([limits for limits, _ in parts]), np.concatenate(ends))
    limits, results = parts[0]
    for steps in parts[1:]:
        results = _advance(results, steps, window)
    if len(parts) > 1:
        # Entered after the first block's last row: the second block decides.
        limits = np.append(limits, parts[1][0][0])
        late = parts[1][1][:1]
        for steps in parts[2:]:
            late = _advance(late, steps, window)
        results = np.append(results, late)
    return _compact(limits, results)


def _pick(times: np.ndarray, last_kept: int, window: int) -> list[int]:
    """Positions of the kept rows of one block."""
    kept, at = [], int(np.searchsorted(times, last_kept + window))
    while at < len(times):
        kept.append(at)
        at = int(np.searchsorted(times, times[at] + window))
    return kept


# --- Arrow batches -----------------------------------------------------------

def _lists(array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and flat values of a list column."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    offsets = array.offsets.to_numpy()
    return offsets - offsets[0], array.values.slice(offsets[0], offsets[-1] - offsets[0])


def _as_lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _with_columns(batch: pa.RecordBatch, names: list[str], added: dict[str, pa.Array]):
    columns = [batch.column(n) for n in names]
    return pa.RecordBatch.from_arrays([*columns, *added.values()], names=[*names, *added])


def _children(column):
    """Per row: list of (node, steps) in time order."""
    offsets, nodes = _lists(column)
    ids = nodes.field("node").to_numpy(zero_copy_only=False)
    lim_at, limits = _lists(nodes.field("limits"))
    res_at, results = _lists(nodes.field("results"))
    limits, results = limits.to_numpy(zero_copy_only=False), results.to_numpy(zero_copy_only=False)
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield [
            (int(ids[i]), (limits[lim_at[i]:lim_at[i + 1]], results[res_at[i]:res_at[i + 1]]))
            for i in range(a, b)
        ]


def _leaf_mapper(keys: list[str], window: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, rows = _lists(batch.column("rows"))
            times = rows.field("t").to_numpy(zero_copy_only=False)
            starts = batch.column("node").to_numpy() * (BLOCK_WINDOWS * window)
            steps = [
                _block_steps(times[a:b], s, window, whole)
                for a, b, s in zip(offsets[:-1], offsets[1:], starts)
            ]
            yield _with_columns(batch, [*keys, "node"], {
                "limits": _as_lists([s[0] for s in steps]),
                "results": _as_lists([s[1] for s in steps]),
            })
    return run


def _chain_mapper(keys: list[str], window: int, whole: bool):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            steps = [
                _chain_steps([s for _, s in parts], window, whole)
                for parts in _children(batch.column("children"))
            ]
            yield _with_columns(batch, [*keys, "node"], {
                "limits": _as_lists([s[0] for s in steps]),
                "results": _as_lists([s[1] for s in steps]),
            })
    return run


def _descend_mapper(keys: list[str], window: int):
    """Row with ``children`` and ``last_kept``: one row per child with its own."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            owners, nodes, states = [], [], []
            entering = batch.column("last_kept").to_pylist()
            for row, parts in enumerate(_children(batch.column("children"))):
                state = np.array([_NEVER if entering[row] is None else entering[row]])
                for node, steps in parts:
                    owners.append(row)
                    nodes.append(node)
                    states.append(int(state[0]))
                    state = _advance(state, steps, window)
            owned = batch.select(keys).take(pa.array(owners, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*owned.columns, pa.array(nodes, pa.int64()), pa.array(states, pa.int64())],
                names=[*keys, "node", "last_kept"],
            )
    return run


def _pick_mapper(keys: list[str], window: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, rows = _lists(batch.column("rows"))
            times = rows.field("t").to_numpy(zero_copy_only=False)
            states = batch.column("last_kept").to_pylist()
            owners, picked = [], []
            for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                kept = _pick(times[a:b], states[row], window)
                owners += [row] * len(kept)
                picked += [int(a) + k for k in kept]
            owned = batch.select(keys).take(pa.array(owners, pa.int64()))
            chosen = rows.take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*owned.columns, chosen.field("t"), chosen.field("tie")],
                names=[*keys, "t", "tie"],
            )
    return run


# --- the operator --------------------------------------------------------------

def levels_for(range_us: int, window_us: int) -> int:
    """Levels needed so that at most ``FAN`` step functions are left per key."""
    blocks, levels = range_us // (BLOCK_WINDOWS * window_us) + 2, 0
    while blocks > FAN:
        blocks, levels = blocks // FAN + 2, levels + 1
    return levels


def kept_moments(df: DataFrame, keys: list[str], time: str, tie: str,
                 window_us: int = DEDUP_WINDOW_US, levels: int | None = None,
                 previous: DataFrame | None = None) -> DataFrame:
    """Keys, time and tie of the rows that are kept.

    Of rows with equal time the smallest ``tie`` counts. ``previous`` holds, per key,
    the ``last_kept`` time from before this data.
    """
    if levels is None:
        low, high = df.agg(F.min(time), F.max(time)).first()
        levels = levels_for((high - low) if low is not None else 0, window_us)
    schema = df.schema
    key_fields = [schema[k] for k in keys]
    longs = T.ArrayType(T.LongType())
    node_field = T.StructField("node", T.LongType())
    step_schema = T.StructType([*key_fields, node_field, T.StructField("limits", longs),
                                T.StructField("results", longs)])
    state_schema = T.StructType([*key_fields, node_field, T.StructField("last_kept", T.LongType())])

    moments = df.groupBy(*keys, F.col(time).alias("t")).agg(F.min(tie).alias("tie"))
    leaves = (
        moments.withColumn("node", F.floor(F.col("t") / (BLOCK_WINDOWS * window_us)).cast("long"))
        .groupBy(*keys, "node")
        .agg(F.sort_array(F.collect_list(F.struct("t", "tie"))).alias("rows"))
    )

    def gather(nodes: DataFrame, *by) -> DataFrame:
        return nodes.groupBy(*keys, *by).agg(
            F.sort_array(F.collect_list(F.struct("node", "limits", "results"))).alias("children")
        )

    carried = previous is not None
    nodes = leaves.mapInArrow(_leaf_mapper(keys, window_us, carried), step_schema)
    gathered = []
    for _ in range(levels):
        parent = nodes.withColumn("parent", F.floor(F.col("node") / FAN).cast("long"))
        groups = gather(parent, "parent").withColumnRenamed("parent", "node")
        gathered.append(groups)
        nodes = groups.mapInArrow(_chain_mapper(keys, window_us, carried), step_schema)

    top = gather(nodes)
    if previous is None:
        top = top.withColumn("last_kept", F.lit(None).cast("long"))
    else:
        top = join_keys(top, previous.select(*keys, "last_kept"), keys, "left")
    states = top.mapInArrow(_descend_mapper(keys, window_us), state_schema)
    for groups in reversed(gathered):
        states = join_keys(groups, states, [*keys, "node"]).mapInArrow(
            _descend_mapper(keys, window_us), state_schema
        )
    picked = join_keys(leaves, states, [*keys, "node"]).mapInArrow(
        _pick_mapper(keys, window_us),
        T.StructType([*key_fields, T.StructField("t", schema[time].dataType),
                      T.StructField("tie", schema[tie].dataType)]),
    )
    return picked.withColumnsRenamed({"t": time, "tie": tie})


def same_rows(df: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` whose keys, nulls included, are in ``kept``."""
    named = kept.select(*[F.col(k).alias(f"_right_{i}") for i, k in enumerate(keys)])
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{i}")) for i, k in enumerate(keys)])
    return df.join(named, match, "left_semi")


def greedy_dedup(df: DataFrame, keys: list[str], time: str, tie: str,
                 window_us: int = DEDUP_WINDOW_US, levels: int | None = None,
                 previous: DataFrame | None = None) -> DataFrame:
    """The kept rows of ``df``, all columns; ``tie`` must tell rows apart."""
    kept = kept_moments(df, keys, time, tie, window_us, levels, previous)
    return same_rows(df, kept, [*keys, time, tie])


def cache_content(kept: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Per key the time of its last kept row."""
    return kept.groupBy(*keys).agg(F.max(time).alias("last_kept"))


def expired_entries(cache: DataFrame, as_of_us: int, window_us: int = DEDUP_WINDOW_US) -> DataFrame:
    """Entries a cleanup at ``as_of_us`` removes."""
    return cache.where(F.col("last_kept") < as_of_us - window_us)


def live_entries(cache: DataFrame, as_of_us: int, window_us: int = DEDUP_WINDOW_US) -> DataFrame:
    return cache.where(F.col("last_kept") >= as_of_us - window_us)


def dedup_stats(candidates: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Checks, blocked, unique, cache size and block rate in percent."""
    checks = candidates.agg(F.count(F.lit(1)).alias("total_checks"))
    sizes = (
        kept.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("unique_alerts"),
            F.count(F.lit(1)).alias("cache_size"),
        )
    )
    blocked = F.col("total_checks") - F.col("unique_alerts")
    # Both sides are one row.
    return checks.join(F.broadcast(sizes), F.lit(True)).select(
        "total_checks",
        blocked.alias("duplicates_blocked"),
        "unique_alerts",
        "cache_size",
        F.round(
            F.when(F.col("total_checks") > 0, blocked / F.col("total_checks") * 100).otherwise(0.0), 2
        ).alias("block_rate"),
    )
