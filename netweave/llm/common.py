"""What the operators of this subpackage share: tables, words, lower case, work tables."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.session import work_path

BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]++"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Letters other than A-Z that lower() would change.
OTHER_CAPITALS = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed.

    ``lower`` is far faster than ``translate``, so it is taken wherever both agree.
    """
    return F.when(text.rlike(OTHER_CAPITALS), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def word_count(text: Column) -> Column:
    """Number of words, 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text in order; none for a null or blank text."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def saved(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; the frame that reads it back, and its path."""
    spark = df.sparkSession
    path = work_path(spark, f"llm-{purpose}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a work table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(spark: SparkSession, path: str) -> int:
    """Bytes of a work table."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def sweep(spark: SparkSession) -> None:
    """Let the driver collect what is finished, so that shuffle files no longer needed go at once."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
