"""Upkeep of lists, settings and logs kept as append-only tables.

The winner among rows of one key is found by an aggregate, which combines before
it shuffles, so a key with many rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.operators.prep import ranked


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every key."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(key) if c == key else F.col(f"_row.{c}") for c in df.columns])


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(key) if c == key else F.col(f"_row.{c}") for c in df.columns])


def list_insert(existing: DataFrame, added: DataFrame, key: str = "ip_address",
                order=("added_us", "id")) -> DataFrame:
    """The list with new entries; an entry whose key is there already is refused."""
    fresh = first_per_key(added, key, list(order)).join(existing, key, "left_anti")
    return existing.unionByName(fresh)


def list_remove(existing: DataFrame, removed: DataFrame, key: str = "ip_address") -> DataFrame:
    return existing.join(removed.select(key).distinct(), key, "left_anti")


def newest_entries(entries: DataFrame) -> DataFrame:
    return entries.orderBy(F.desc("added_us"), F.desc("id"))


def delete_rows(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The table without the rows whose ids are given."""
    return df.join(ids.select(key), key, "left_anti")


def settings(log: DataFrame) -> DataFrame:
    """The last value written for every key."""
    return latest_per_key(log, "config_key", ["updated_us", "id"])


def setting(log: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """One row: the key's value, or the default when it was never written."""
    value = F.max_by("config_value", F.struct("updated_us", "id"))
    found = log.where(F.col("config_key") == key).agg(value.alias("_value"))
    return found.select(
        F.lit(key).alias("config_key"),
        F.coalesce(F.col("_value"), F.lit(default).cast("string")).alias("config_value"),
    )


def settings_without(log: DataFrame, keys: DataFrame) -> DataFrame:
    return settings(log).join(keys.select("config_key").distinct(), "config_key", "left_anti")


def latest_training(logs: DataFrame) -> DataFrame:
    return logs.orderBy(F.desc("trained_us"), F.desc("id")).limit(1)


def training_history(logs: DataFrame, limit: int = 50) -> DataFrame:
    return logs.orderBy(F.desc("trained_us"), F.desc("id")).limit(limit)


def next_ids(stored: DataFrame, fresh: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """``fresh`` with ids that follow the greatest in ``stored``, without gaps, in the given order.

    The order must tell rows apart; the ids then depend on the rows alone, so that a task
    run again gives the same ones.
    """
    top = stored.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    numbered = ranked(fresh, order).join(F.broadcast(top), F.lit(True))
    return numbered.withColumn(key, F.col("_rank") + F.col("_top") + 1).drop("_rank", "_top")


def append(stored: DataFrame, fresh: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """The table with new rows at its end, under new ids."""
    return stored.unionByName(next_ids(stored, fresh, order, key).select(*stored.columns))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
