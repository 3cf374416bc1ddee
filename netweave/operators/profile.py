"""What is in a table of flows: classes, gaps, infinities, ranges, names.

Every profile is one aggregate over the table, whatever the number of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.constants import LITERATURE_FEATURES, NAME_GROUPS
from netweave.functions.scalars import col_of, is_infinite, is_missing


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _is_double(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def missing(df: DataFrame, name: str) -> Column:
    return is_missing(col_of(name), _is_double(df, name))


def infinite(df: DataFrame, name: str) -> Column:
    return is_infinite(col_of(name)) if _is_double(df, name) else F.lit(False)


def per_column(df: DataFrame, metrics: dict[str, dict[str, Column]]) -> DataFrame:
    """One pass over ``df``; one row per column name with its metrics."""
    rows = [
        F.struct(F.lit(name).alias("column_name"), *[m.alias(k) for k, m in found.items()])
        for name, found in metrics.items()
    ]
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def missing_profile(df: DataFrame) -> DataFrame:
    """Columns with missing values, their number and percentage."""
    everything = F.count(F.lit(1))
    found = per_column(df, {
        c: {"missing_count": F.count_if(missing(df, c)), "total": everything} for c in df.columns
    })
    return found.where(F.col("missing_count") > 0).select(
        "column_name", "missing_count",
        F.round(F.col("missing_count") / F.col("total") * 100, 4).alias("missing_pct"),
    )


def infinity_profile(df: DataFrame) -> DataFrame:
    """The numeric columns with infinities, most first."""
    found = per_column(df, {
        c: {"infinite_count": F.count_if(infinite(df, c))} for c in numeric_columns(df)
    })
    # One row per column.
    return found.where(F.col("infinite_count") > 0).orderBy(F.desc("infinite_count"), "column_name")


def numeric_ranges(df: DataFrame) -> DataFrame:
    """Smallest and greatest value of every numeric column."""
    return per_column(df, {
        c: {"min_value": F.min(col_of(c).cast("double")), "max_value": F.max(col_of(c).cast("double"))}
        for c in numeric_columns(df)
    })


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and percentage per class; the total is summed over the few class rows."""
    counted = df.groupBy(col_of(label).alias("label")).agg(F.count(F.lit(1)).alias("row_count"))
    total = counted.agg(F.sum("row_count").alias("_total"))
    # The total is one row.
    return counted.join(F.broadcast(total), F.lit(True)).select(
        "label", "row_count", F.round(F.col("row_count") / F.col("_total") * 100, 4).alias("pct")
    )


def quality_check(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows, columns, missing and infinite cells, classes."""
    add = lambda parts: sum(parts[1:], parts[0]) if parts else F.lit(0)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        add([F.count_if(missing(df, c)) for c in df.columns]).alias("missing_total"),
        add([F.count_if(infinite(df, c)) for c in numeric_columns(df)]).alias("infinite_total"),
        F.count_distinct(col_of(label)).alias("class_count"),
    )


def dtype_counts(df: DataFrame) -> dict[str, int]:
    """Columns per data type; read off the schema."""
    found: dict[str, int] = {}
    for _, kind in df.dtypes:
        found[kind] = found.get(kind, 0) + 1
    return found


def name_groups(columns: list[str]) -> dict[str, list[str]]:
    """Columns whose name holds one of the group's words."""
    return {
        group: [c for c in columns if any(word in c for word in words)]
        for group, words in NAME_GROUPS.items()
    }


def feature_categories(df: DataFrame) -> DataFrame:
    """Per column the name groups it belongs to and how many values it holds."""
    groups = name_groups(df.columns)
    return per_column(df, {
        c: {
            **{f"is_{group}": F.lit(c in members) for group, members in groups.items()},
            "value_count": F.count(col_of(c)),
        }
        for c in df.columns
    })


def literature_matches(columns: list[str]) -> dict[str, str | None]:
    """For every feature the literature names, the first column that holds the name."""
    return {
        feature: next((c for c in columns if feature.lower() in c.lower()), None)
        for feature in LITERATURE_FEATURES
    }
