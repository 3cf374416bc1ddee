"""Nested documents: metrics and feature lists as JSON, score tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT_SCHEMA = """
map<string, struct<accuracy: double, precision: double, recall: double, f1_score: double,
 classification_report: map<string, string>, confusion_matrix: array<array<bigint>>>>
"""


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_metrics(splits: dict[str, DataFrame], path: str) -> None:
    """One object with a member per split; each frame is one row of figures."""
    out = None
    for name, figures in splits.items():
        one = figures.select(F.struct(*figures.columns).alias(name))
        out = one if out is None else out.join(F.broadcast(one), F.lit(True))
    write_json(out.coalesce(1), path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """split and its figures; an entry of the report is the text of an object or of a number."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", SPLIT_SCHEMA)).alias("split", "f")).select("split", "f.*")


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").option("header", True).csv(path)


def feature_list(selected: DataFrame) -> DataFrame:
    """The chosen features as one record; at most some dozens of names."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "feature")))
    return selected.agg(
        F.transform(ordered, lambda s: s["feature"]).alias("selected_features"),
        F.count(F.lit(1)).alias("n_features"),
    )


def feature_mapping(selected: DataFrame) -> DataFrame:
    """The chosen features and the index of each, from 0, as one record."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "feature")))
    index = F.map_from_entries(F.transform(ordered, lambda s, i: F.struct(s["feature"], i)))
    return selected.agg(F.transform(ordered, lambda s: s["feature"]).alias("selected_features"), index.alias("feature_indices"))
