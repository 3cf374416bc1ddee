"""Exact order statistics of any number of rows.

The built-in exact median keeps every distinct value of a group in one place. Here
a mergeable sketch of fixed size proposes cut points, a counting pass finds between
which of them each wanted rank lies, and so on until few enough values are left to
be sorted. The counts are exact, so the result is, whatever the sketch's error. A
pass serves all columns and ranks at once, and the driver sees cut points and counts
only.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: At most this many values are sorted in one place.
SORT_LIMIT = 200_000
#: Cut points per round, and the rank error of the sketch that proposes them.
CUTS = 256
ACCURACY = 4_000


@dataclass
class _Bracket:
    """The values of a column strictly between two bounds, and the ranks among them."""

    column: int
    low: float | None
    high: float | None
    below: int
    size: int
    ranks: list[int] = field(default_factory=list)


def _number(value: float) -> str:
    if math.isinf(value):
        return f"double('{'-' if value < 0 else ''}Infinity')"
    return f"{float(value)!r}D"


def with_bounds_below(rows: DataFrame, bounds: list[list[float]], to: str) -> DataFrame:
    """Add how many of its column's sorted bounds lie below each value, by halving.

    Rows hold the column's number ``c`` and the value ``v``. The bounds are one
    constant, so the work stays in generated code whatever their number.
    """
    lists = ", ".join(
        f"array({', '.join(_number(b) for b in bs)})" if bs else "cast(array() as array<double>)" for bs in bounds
    )
    rows = rows.withColumn("_b", F.expr(f"get(array({lists}), c)")).withColumn(to, F.lit(0))
    for step in reversed(range(max(len(bs) for bs in bounds).bit_length())):
        ahead = F.get("_b", F.col(to) + (2 ** step - 1))
        rows = rows.withColumn(to, F.col(to) + F.when(ahead < F.col("v"), 2 ** step).otherwise(0))
    return rows


def _place(bracket: _Bracket, bounds: list[float]) -> int:
    """The position of a bracket's values among its column's bounds."""
    return 0 if bracket.low is None else 2 * (bisect_left(bounds, bracket.low) + 1)


def long_values(df: DataFrame, values: dict[int, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row and column: the column's number ``c`` and the value ``v``."""
    named = df.select(*keep, *[value.alias(f"_v{i}") for i, value in values.items()])
    return named.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col(f"_v{i}").alias("v")) for i in values
    ])))


def _long(df: DataFrame, values: list[Column], bounds: list[list[float]],
          wanted: list[list[int]] | None = None) -> DataFrame:
    """One row per value: column number, position among the bounds, value.

    The position is 2i between the i-th bound and the one before it, 2i+1 on it.
    """
    used = [i for i in range(len(values)) if wanted is None or wanted[i]]
    rows = long_values(df, {i: values[i] for i in used}).where(F.col("v").isNotNull())
    rows = with_bounds_below(rows, bounds, "less")
    on_bound = F.coalesce(F.get("_b", "less") == F.col("v"), F.lit(False))
    rows = rows.withColumn("p", F.col("less") * 2 + on_bound.cast("int"))
    if wanted is not None and any(bounds):
        # A join rather than a filter, which would repeat the search in its condition.
        asked = df.sparkSession.range(1).select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("c"), F.lit(p).alias("p")) for i in used for p in wanted[i]
        ])))
        rows = rows.join(F.broadcast(asked), ["c", "p"], "left_semi")
    return rows.select("c", "p", "v")


def _grouped(brackets: list[_Bracket], columns: int):
    """Per column the bounds of its brackets and the brackets by position."""
    bounds = [
        sorted({b for s in brackets if s.column == i for b in (s.low, s.high) if b is not None})
        for i in range(columns)
    ]
    at = {(s.column, _place(s, bounds[s.column])): s for s in brackets}
    wanted = [[p for c, p in at if c == i] for i in range(columns)]
    return bounds, at, wanted


def _sorted_lookup(df: DataFrame, values: list[Column], brackets: list[_Bracket]) -> dict[tuple[int, int], float]:
    """Ranks within small brackets, each sorted in its own group."""
    bounds, at, wanted = _grouped(brackets, len(values))
    asked = [(c, p, r, r - s.below) for (c, p), s in at.items() for r in s.ranks]
    targets = df.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("c"), F.lit(p).alias("p"), F.lit(r).cast("long").alias("r"), F.lit(n).alias("n"))
        for c, p, r, n in asked
    ])))
    # Equal values are counted together before the shuffle.
    counted = _long(df, values, bounds, wanted).groupBy("c", "p", "v").agg(F.count(F.lit(1)).alias("times"))
    upto = F.sum("times").over(Window.partitionBy("c", "p").orderBy("v"))
    ranked = counted.withColumn("upto", upto).join(F.broadcast(targets), ["c", "p"])
    found = ranked.where((F.col("n") <= F.col("upto")) & (F.col("n") > F.col("upto") - F.col("times")))
    return {(c, r): v for c, r, v in found.select("c", "r", "v").collect()}


def _narrowed(df: DataFrame, values: list[Column], brackets: list[_Bracket], done: dict) -> list[_Bracket]:
    """Cut every bracket at its quantiles, count, and keep the parts that hold a rank."""
    bounds, at, wanted = _grouped(brackets, len(values))
    shares = [i / CUTS for i in range(CUTS + 1)]
    sketched = _long(df, values, bounds, wanted).groupBy("c", "p").agg(
        F.percentile_approx("v", shares, ACCURACY).alias("cuts")
    ).collect()
    fine = [set(b) for b in bounds]
    for c, _, cuts in sketched:
        fine[c].update(cuts)
    fine = [sorted(b) for b in fine]
    counts: dict[int, dict[int, int]] = {}
    for c, p, n in _long(df, values, fine).groupBy("c", "p").count().collect():
        counts.setdefault(c, {})[p] = n
    left = []
    for (c, _), s in at.items():
        edges = fine[c]
        start = 0 if s.low is None else bisect_left(edges, s.low) + 1
        stop = len(edges) if s.high is None else bisect_left(edges, s.high)
        below = s.below
        ranks = sorted(s.ranks)
        for i in range(start, stop + 1):
            between = counts.get(c, {}).get(2 * i, 0)
            inside = [r for r in ranks if below < r <= below + between]
            if inside:
                left.append(_Bracket(c, edges[i - 1] if i else None, edges[i] if i < len(edges) else None,
                                     below, between, inside))
            below += between
            if i < stop:
                equal = counts.get(c, {}).get(2 * i + 1, 0)
                done.update({(c, r): edges[i] for r in ranks if below < r <= below + equal})
                below += equal
    return left


def order_statistics(df: DataFrame, values: dict[str, Column], ranks: dict[str, list[int]],
                     counts: dict[str, int], limit: int = SORT_LIMIT) -> dict[tuple[str, int], float]:
    """The value at each rank (1 is the smallest) of each column.

    ``values`` gives the numeric expression per name, null where it does not count;
    ``counts`` its number of non-null values.
    """
    names = list(ranks)
    columns = [values[n].cast("double") for n in names]
    brackets = [_Bracket(i, None, None, 0, counts[n], sorted(set(ranks[n]))) for i, n in enumerate(names)]
    done: dict[tuple[int, int], float] = {}
    while brackets:
        few = [s for s in brackets if s.size <= limit]
        many = [s for s in brackets if s.size > limit]
        if few:
            done.update(_sorted_lookup(df, columns, few))
        brackets = _narrowed(df, columns, many, done) if many else []
    return {(names[c], r): v for (c, r), v in done.items()}


def value_counts(df: DataFrame, values: dict[str, Column]) -> dict[str, int]:
    """Non-null values per name, in one pass."""
    found = df.agg(*[F.count(v).alias(f"_{i}") for i, v in enumerate(values.values())]).first()
    return dict(zip(values, found))


def exact_medians(df: DataFrame, values: dict[str, Column], limit: int = SORT_LIMIT,
                  counts: dict[str, int] | None = None) -> dict[str, float | None]:
    """Median per name: the mean of the two middle values when their number is even."""
    counts = counts or value_counts(df, values)
    ranks = {c: [(n + 1) // 2, n // 2 + 1] for c, n in counts.items() if n}
    found = order_statistics(df, values, ranks, counts, limit)
    return {
        c: (found[c, (n + 1) // 2] + found[c, n // 2 + 1]) / 2 if n else None
        for c, n in counts.items()
    }


def exact_quantiles(df: DataFrame, values: dict[str, Column], shares: list[Fraction],
                    limit: int = SORT_LIMIT) -> dict[str, list[float]]:
    """The smallest values that at least the given shares of values do not exceed."""
    counts = value_counts(df, values)
    at = {c: [max(1, math.ceil(p * n)) for p in shares] for c, n in counts.items() if n}
    found = order_statistics(df, values, at, counts, limit)
    return {c: [found[c, r] for r in at[c]] if c in at else [] for c in values}
