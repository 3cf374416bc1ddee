"""Sessions by idle gap, without putting one key's rows into one task.

A key may hold a large share of all rows. Rows are therefore grouped by key *and*
a fixed span of event time. Each span is worked on by itself; what crosses a span
border is carried in one small row per key and span. The number of those rows per
key is bounded by the time range, not by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.functions.scalars import join_keys

#: Event time per group of rows of one key.
SPAN_US = 60_000_000


def with_span(df: DataFrame, time: str, span_us: int = SPAN_US) -> DataFrame:
    return df.withColumn("_span", F.floor(F.col(time) / F.lit(span_us)).cast("long"))


def assign_sessions(
    df: DataFrame,
    keys: list[str],
    time: str,
    tie: str,
    gap_us: int,
    starts: dict[str, Column],
    lasts: dict[str, Column] | None = None,
    span_us: int = SPAN_US,
) -> DataFrame:
    """Give every row its session.

    Rows of a key are ordered by ``time`` and ``tie``; a row at least ``gap_us``
    after its predecessor starts a session. Added columns: ``session_no`` (1, 2, ..
    per key), ``prev_time`` and ``prev_tie`` (previous row of the session, else
    null), for each entry of ``starts`` its value at the session's first row, and for each entry
    of ``lasts`` its greatest value over earlier rows of the key (values must grow
    with time).
    """
    lasts = lasts or {}
    cell = [*keys, "_span"]
    rows = with_span(df, time, span_us)
    order = Window.partitionBy(*cell).orderBy(time, tie)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    rows = rows.withColumns(
        {"_prev": F.lag(time).over(order), "_ptie": F.lag(tie).over(order)}
    )
    rows = rows.withColumn(
        "_new", F.col("_prev").isNull() | (F.col(time) - F.col("_prev") >= gap_us)
    )
    rows = rows.withColumns(
        {
            "_no": F.sum(F.col("_new").cast("long")).over(upto),
            **{
                f"_s_{name}": F.last(F.when(F.col("_new"), value), ignorenulls=True).over(upto)
                for name, value in starts.items()
            },
            **{f"_l_{name}": F.max(value).over(before) for name, value in lasts.items()},
            **{f"_v_{name}": value for name, value in lasts.items()},
        }
    )

    cells = rows.groupBy(*cell).agg(
        F.min(time).alias("_first"),
        F.max(time).alias("_last"),
        F.max_by(tie, F.struct(time, tie)).alias("_ltie"),
        F.max("_no").alias("_count"),
        *[F.max(F.when(F.col("_no") == 1, F.col(f"_s_{n}"))).alias(f"_head_{n}") for n in starts],
        *[F.max_by(f"_s_{n}", "_no").alias(f"_tail_{n}") for n in starts],
        *[F.max(f"_v_{n}").alias(f"_top_{n}") for n in lasts],
    )
    spans = Window.partitionBy(*keys).orderBy("_span")
    earlier = spans.rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns(
        {"_carry": F.lag("_last").over(spans), "_ctie": F.lag("_ltie").over(spans)}
    )
    cells = cells.withColumn(
        "_joined", F.coalesce(F.col("_first") - F.col("_carry") < gap_us, F.lit(False))
    )
    open_start = {
        n: F.when(F.col("_count") > 1, F.col(f"_tail_{n}")).when(
            ~F.col("_joined"), F.col(f"_head_{n}")
        )
        for n in starts
    }
    cells = cells.select(
        *cell,
        "_carry",
        "_ctie",
        "_joined",
        F.coalesce(
            F.sum(F.col("_count") - F.col("_joined").cast("long")).over(earlier), F.lit(0)
        ).alias("_sessions"),
        *[
            F.last(value, ignorenulls=True).over(earlier).alias(f"_open_{n}")
            for n, value in open_start.items()
        ],
        *[F.max(f"_top_{n}").over(earlier).alias(f"_before_{n}") for n in lasts],
    )

    joined = join_keys(rows, cells, cell)
    carried = F.col("_joined") & (F.col("_no") == 1)
    first_carried = carried & F.col("_prev").isNull()
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("_sessions") + F.col("_no") - F.col("_joined").cast("long")).alias("session_no"),
        F.when(first_carried, F.col("_carry"))
        .when(~F.col("_new"), F.col("_prev"))
        .alias("prev_time"),
        F.when(first_carried, F.col("_ctie"))
        .when(~F.col("_new"), F.col("_ptie"))
        .alias("prev_tie"),
        *[F.when(carried, F.col(f"_open_{n}")).otherwise(F.col(f"_s_{n}")).alias(n) for n in starts],
        *[F.greatest(f"_l_{n}", f"_before_{n}").alias(n) for n in lasts],
    )
