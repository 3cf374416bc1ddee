"""Duplicate suppression over an endless table, on the engine's state, watermark and timers.

Per key the state is the time of the last kept row and the rows that the watermark has not passed. A timer on the
earliest of those wakes the key once it is passed; rows are then judged in order of time, whatever the order in
which they came. A key with nothing left to judge is forgotten once its last kept row is a window behind the
watermark. Rows behind the watermark are dropped by the engine. A restart goes on from the checkpoint.

A call of the engine for a group costs far more than a row, so the keys are dealt by hash into ``GROUPS`` groups that share
a state and a timer. A group's rows of one micro-batch are one task's work, and what waits for the watermark is held per
group; the batch operator in ``operators.dedup`` spreads a key instead.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Groups of keys; a checkpoint is bound to their number.
GROUPS = 1024


def judged(last: int | None, ready: list, window_us: int) -> tuple[int | None, list]:
    """The last kept time and the kept rows after ``ready`` (time, tie, row), taken in order."""
    kept = []
    for moment, _, row in sorted(ready, key=lambda r: (r[0], r[1])):
        if last is None or moment - last >= window_us:
            last = moment
            kept.append(row)
    return last, kept


def _walk(window_us: int):
    def run(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, held = map(json.loads, state.get) if state.exists else ({}, [])
        for frame in frames:
            held += zip(*[frame[c].tolist() for c in ("_time", "_tie", "_row", "_key")])
        mark = state.getCurrentWatermarkMs() * 1000
        ready, kept = {}, []
        for moment, tie, row, key in held:
            if moment < mark:
                ready.setdefault(key, []).append((moment, tie, row))
        for key, rows in ready.items():
            known[key], some = judged(known.get(key), rows, window_us)
            kept += some
        held = [r for r in held if r[0] >= mark]
        waiting = {r[3] for r in held}
        known = {k: last for k, last in known.items() if k in waiting or last + window_us > mark}
        if not held and not known:
            state.remove()
        else:
            state.update((json.dumps(known), json.dumps(held)))
            wake = [r[0] for r in held] + [last + window_us for k, last in known.items() if k not in waiting]
            state.setTimeoutTimestamp(min(wake) // 1000 + 1)
        yield pd.DataFrame({"kept": kept})
    return run


def suppressed(rows: DataFrame, keys: list[str], time: str, tie: str, window_us: int, delay_us: int, groups: int = GROUPS) -> DataFrame:
    """The kept rows of a stream, all columns; ``tie`` is a whole number that orders rows of equal time."""
    marked = rows.withColumn("_at", F.timestamp_micros(time)).withWatermark("_at", f"{delay_us} microseconds")
    told = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    packed = marked.select(
        F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_group"), F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key"),
        "_at", F.col(time).alias("_time"), F.coalesce(F.col(tie), F.lit(-1)).cast("long").alias("_tie"), told.alias("_row"))
    kept = packed.groupBy("_group").applyInPandasWithState(
        _walk(window_us), "kept string", "known string, held string", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.select(F.from_json("kept", rows.schema).alias("r")).select("r.*")
