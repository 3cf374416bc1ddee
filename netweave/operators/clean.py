"""Choosing classes and columns, and repairing infinite and missing values.

Repairs are learned first, as a few numbers per column, and then applied row by
row without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.constants import CLASSES
from netweave.functions.quantiles import exact_medians, value_counts
from netweave.functions.scalars import col_of, finite_or_zero, is_finite, is_infinite, is_missing
from netweave.operators.profile import numeric_columns


def keep_classes(df: DataFrame, classes=CLASSES, label: str = "label") -> DataFrame:
    return df.where(col_of(label).isin(list(classes)))


def unexpected_labels(df: DataFrame, expected=CLASSES, label: str = "label") -> DataFrame:
    """Labels that are not expected, with their number of rows."""
    return (
        df.where(~col_of(label).isin(list(expected)) | col_of(label).isNull())
        .groupBy(col_of(label).alias("label"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def require_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    absent = missing_columns(df, wanted)
    if absent:
        raise ValueError(f"columns not found: {absent}")
    return df


def select_features(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns; a name may differ in surrounding spaces.

    One column may be absent; with more absent the table is refused.
    """
    trimmed: dict[str, str] = {}
    for c in df.columns:
        trimmed.setdefault(c.strip(), c)
    exact = [c for c in wanted if c in df.columns]
    similar = [trimmed[c.strip()] for c in wanted if c not in df.columns and c.strip() in trimmed]
    if len(exact) + len(similar) < len(wanted) - 1:
        raise ValueError("too many wanted columns are not in the table")
    return df.select(*[col_of(c) for c in [*exact, *similar]])


def _doubles(df: DataFrame, columns: list[str] | None) -> list[str]:
    kinds = dict(df.dtypes)
    return [c for c in (columns or numeric_columns(df)) if kinds[c] in ("double", "float")]


def finite_maxima(df: DataFrame, columns: list[str] | None = None) -> dict[str, float]:
    """Greatest finite value per column; 0 where there is none. One pass."""
    names = _doubles(df, columns)
    if not names:
        return {}
    found = df.agg(
        *[F.max(F.when(is_finite(col_of(c)), col_of(c))).alias(f"_{i}") for i, c in enumerate(names)]
    ).first()
    return {c: 0.0 if v is None else v for c, v in zip(names, found)}


def replace_infinity(df: DataFrame, maxima: dict[str, float]) -> DataFrame:
    """Both infinities become the column's greatest finite value."""
    return df.withColumns({
        c: F.when(is_infinite(col_of(c)), F.lit(top)).otherwise(col_of(c)) for c, top in maxima.items()
    })


def infinity_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumns({
        c: F.when(~is_infinite(col_of(c)), col_of(c)) for c in _doubles(df, columns)
    })


def medians(df: DataFrame, columns: list[str] | None = None) -> dict[str, float | None]:
    """Exact median of the values that are there, for columns that lack some."""
    values = {c: F.when(~is_missing(col_of(c)), col_of(c)) for c in _doubles(df, columns)}
    counts = value_counts(df, {"": F.lit(1), **values})
    total = counts.pop("")
    lacking = {c: n for c, n in counts.items() if n < total}
    return exact_medians(df, {c: values[c] for c in lacking}, counts=lacking) if lacking else {}


def fill_missing(df: DataFrame, fills: dict[str, float | None]) -> DataFrame:
    return df.withColumns({
        c: F.when(is_missing(col_of(c)), F.lit(v).cast("double")).otherwise(col_of(c))
        for c, v in fills.items() if v is not None
    })


def repairs(df: DataFrame, columns: list[str] | None = None) -> tuple[dict[str, float], dict[str, float | None]]:
    """What ``clean`` puts in place of infinite and of missing values, per column."""
    maxima = finite_maxima(df, columns)
    return maxima, medians(replace_infinity(df, maxima), columns)


def clean(df: DataFrame, columns: list[str] | None = None, known=None) -> DataFrame:
    """Infinity to the greatest finite value, then missing to the median; ``known``: the table's ``repairs``."""
    maxima, fills = known or repairs(df, columns)
    return fill_missing(replace_infinity(df, maxima), fills)


def validate(df: DataFrame, columns: list[str] | None = None, classes=CLASSES,
             label: str = "label") -> DataFrame:
    """Infinity to missing, missing to the median, then unexpected labels out."""
    require_columns(df, [label])
    open_cells = infinity_to_null(df, columns)
    return keep_classes(fill_missing(open_cells, medians(open_cells, columns)), classes, label)


def invalid_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows that lack a feature value."""
    require_columns(df, features)
    bad = F.lit(False)
    for c in features:
        bad = bad | is_missing(col_of(c).cast("double"))
    return df.where(bad)


def scorable_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows whose features are all finite numbers."""
    require_columns(df, features)
    good = F.lit(True)
    for c in features:
        good = good & is_finite(col_of(c).cast("double"))
    return df.where(good)


def finite_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Non-finite feature values become 0."""
    return df.withColumns({c: finite_or_zero(col_of(c)) for c in features})
