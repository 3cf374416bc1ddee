"""Is a value on a list? Semi, anti and tagging joins that stand hot values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A list of at most this many short strings is sent to every executor.
BROADCAST_ROWS = 200_000
#: Beyond that, rows of one value are spread over this many groups.
SALTS = 16


def _small(members: DataFrame) -> bool:
    return members.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _join(df: DataFrame, column: str, members: DataFrame, member: str, how: str,
          small: bool | None = None) -> DataFrame:
    listed = members.select(F.col(member).alias(column)).distinct()
    if small is None:
        small = _small(listed)
    if how == "left":
        listed = listed.withColumn("_listed", F.lit(True))
    if small:
        return df.join(F.broadcast(listed), column, how)
    # The salt is a function of the row, so a retried task repeats it.
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    copies = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [column, "_salt"], how).drop("_salt")


def only_members(df, column, members, member, small=None):
    """Rows whose value is on the list."""
    return _join(df, column, members, member, "left_semi", small)


def without_members(df, column, members, member, small=None):
    """Rows whose value is not on the list."""
    return _join(df, column, members, member, "left_anti", small)


def tag_members(df, column, members, member, flag: str, small=None):
    """All rows and whether their value is on the list."""
    joined = _join(df, column, members, member, "left", small)
    return joined.withColumn(flag, F.coalesce(F.col("_listed"), F.lit(False))).drop("_listed")
