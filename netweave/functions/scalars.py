"""Column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.constants import CRITICAL_CONFIDENCE

# Four numbers of one to three digits; each must be 255 at most besides.
IPV4_PATTERN = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}\z"


def col_of(name: str) -> Column:
    """A column by its exact name, which may hold spaces, dots or slashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys are kept once."""
    named = right.withColumnsRenamed({k: f"_right_{i}" for i, k in enumerate(keys)})
    match = None
    for i, k in enumerate(keys):
        one = col_of(k).eqNullSafe(F.col(f"_right_{i}"))
        match = one if match is None else match & one
    return left.join(named, match, how).drop(*[f"_right_{i}" for i in range(len(keys))])


def flag_set(flags: Column, bit: int) -> Column:
    """1 where the bit is set, else 0."""
    return (flags.bitwiseAND(F.lit(bit)) != 0).cast("int")


def is_infinite(value: Column) -> Column:
    return F.abs(value) == F.lit(float("inf"))


def is_finite(value: Column) -> Column:
    """False for null, NaN and both infinities."""
    return value.isNotNull() & ~F.isnan(value) & ~is_infinite(value)


def is_missing(value: Column, numeric: bool = True) -> Column:
    return (value.isNull() | F.isnan(value)) if numeric else value.isNull()


def finite_or_zero(value: Column) -> Column:
    value = value.cast("double")
    return F.when(is_finite(value), value).otherwise(F.lit(0.0))


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    """``top / bottom``, or ``empty`` where the divisor is zero or null."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(empty))


def severity_of(confidence: Column, limit: float = CRITICAL_CONFIDENCE) -> Column:
    return F.when(confidence >= limit, "critical").otherwise("low")


def parse_iso(text: Column) -> Column:
    """ISO-8601 text, with or without ``Z`` or an offset; null when malformed."""
    shaped = text.rlike(
        r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    )
    return F.when(shaped, F.try_to_timestamp(text))


def iso_text(ts_us: Column) -> Column:
    """Microseconds since the epoch as ISO text; the fraction only if there is one."""
    ts = F.timestamp_micros(ts_us)
    return F.when(
        F.pmod(ts_us, F.lit(1_000_000)) == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def duration_text(seconds: Column) -> Column:
    """``1h 2m 3s``, without leading zero parts."""
    whole = F.floor(seconds).cast("long")
    hours = F.floor(whole / 3600).cast("long")
    minutes = F.floor((whole % 3600) / 60).cast("long")
    secs = (whole % 60).cast("long")
    return (
        F.when(hours > 0, F.format_string("%dh %dm %ds", hours, minutes, secs))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, secs))
        .otherwise(F.format_string("%ds", secs))
    )


def looks_like_ipv4(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return F.coalesce(F.when(text.rlike(IPV4_PATTERN), F.forall(parts, lambda p: p.cast("int") <= 255)), F.lit(False))


def micros(moment: datetime) -> int:
    """A naive UTC moment as microseconds since the epoch."""
    delta = moment - datetime(1970, 1, 1)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
