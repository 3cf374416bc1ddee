"""A registry of models: every version's figures, and notes of which one is in use.

Versions are rows appended to one folder. A promotion is a note with the next number, whose file
appears whole when its write ends, so a reader sees the old model or the new one. The model in use is the one with the
greatest note; going back to an earlier version is one more note.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.constants import ALERT_THRESHOLD, CLASSES, DEDUP_WINDOW_US, MODEL_FEATURES, QUALITY_GATES

VERSION = "id long, version string, algorithm string, accuracy double, f1_score double, trained_us long, features int, classes array<string>"
NOTE = "note long, id long"


def versions_of(logs: DataFrame, algorithm: str = "boosted", features: int = len(MODEL_FEATURES),
                classes: list[str] = CLASSES) -> DataFrame:
    """Registry rows of training-log rows (id, model_version, accuracy, f1_score, trained_us)."""
    return logs.select(
        F.col("id").cast("long").alias("id"), F.col("model_version").alias("version"), F.lit(algorithm).alias("algorithm"), "accuracy", "f1_score",
        F.col("trained_us").cast("long").alias("trained_us"), F.lit(features).alias("features"), F.array(*[F.lit(c) for c in classes]).alias("classes"))


def register(versions: DataFrame, path: str) -> None:
    versions.write.mode("append").parquet(f"{path}/versions")


def versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERSION).parquet(f"{path}/versions")


def passing(known: DataFrame, gates: dict[str, float] = QUALITY_GATES) -> DataFrame:
    """Versions whose accuracy and F1 reach the gates; a missing figure does not."""
    return known.where((F.col("accuracy") >= gates["min_accuracy"]) & (F.col("f1_score") >= gates["min_f1_score"]))


def notes(spark: SparkSession, path: str) -> DataFrame:
    """All promotions so far, none at first."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/notes")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], NOTE)
    return spark.read.schema(NOTE).json(f"{path}/notes")


def promote(spark: SparkSession, path: str, version: DataFrame) -> None:
    """Make the version (a frame with one ``id``, or none) the one in use."""
    last = notes(spark, path).agg(F.coalesce(F.max("note"), F.lit(0)).alias("last")).first()["last"]
    version.select(F.lit(last + 1).cast("long").alias("note"), "id").coalesce(1).write.mode("append").json(f"{path}/notes")


def in_use(spark: SparkSession, path: str) -> DataFrame:
    """The version of the greatest note: one row, or none before the first promotion."""
    newest = notes(spark, path).agg(F.max_by("id", "note").alias("_id"))
    known = versions(spark, path)
    # One row.
    return known.join(F.broadcast(newest), F.col("id") == F.col("_id")).drop("_id")


def model_info(current: DataFrame, threshold: float = ALERT_THRESHOLD, window_us: int = DEDUP_WINDOW_US) -> DataFrame:
    """What is known of the model in use, and how its alerts are made."""
    return current.select(
        "version", "algorithm", F.col("features").alias("features_count"), F.array_join("classes", ",").alias("classes"),
        F.size("classes").alias("classes_count"), "accuracy", "f1_score", "trained_us",
        F.lit(threshold).alias("alert_threshold"), F.lit(window_us // 1_000_000).cast("long").alias("deduplication_window"))


def model_status(current: DataFrame, funnel: DataFrame) -> DataFrame:
    """Whether a model is in use, beside the counters of its detection (one row)."""
    loaded = current.agg((F.count(F.lit(1)) > 0).alias("model_loaded"), F.max("version").alias("version"))
    return loaded.join(F.broadcast(funnel), F.lit(True))
