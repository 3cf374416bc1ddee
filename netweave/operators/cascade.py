"""From scored flows to alerts: filters, allow list, duplicate suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.constants import ALERT_THRESHOLD, ATTACK_CLASSES, DEDUP_WINDOW_US
from netweave.functions.scalars import severity_of
from netweave.operators.alerts import class_counts
from netweave.operators.dedup import greedy_dedup
from netweave.operators.membership import tag_members, without_members

ALERT_KEY = ["source_ip", "attack_type"]


def suspicious(scored: DataFrame, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Attacks the classifier is sure enough of."""
    return scored.where((F.col("attack_type") != "BENIGN") & (F.col("confidence") >= threshold))


def candidates(scored: DataFrame, allow_list: DataFrame,
               threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Suspicious flows whose source is not allow-listed. No shuffle of the flows."""
    return without_members(suspicious(scored, threshold), "source_ip", allow_list, "ip_address")


def with_severity(df: DataFrame) -> DataFrame:
    return df.withColumn("severity", severity_of(F.col("confidence")))


def new_alerts(scored: DataFrame, allow_list: DataFrame, threshold: float = ALERT_THRESHOLD,
               window_us: int = DEDUP_WINDOW_US, levels: int | None = None) -> DataFrame:
    """The alerts a table of scored flows gives rise to."""
    passed = candidates(scored, allow_list, threshold)
    return with_severity(greedy_dedup(passed, ALERT_KEY, "ts_us", "id", window_us, levels))


def funnel(scored: DataFrame, allow_list: DataFrame, threshold: float = ALERT_THRESHOLD,
           window_us: int = DEDUP_WINDOW_US, levels: int | None = None) -> DataFrame:
    """How many flows each step took out, and the alerts made, in one row."""
    tagged = tag_members(scored, "source_ip", allow_list, "ip_address", "listed")
    attack = F.col("attack_type") != "BENIGN"
    sure = F.col("confidence") >= threshold
    before = tagged.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(~attack).alias("benign_filtered"),
        F.count_if(attack & ~sure).alias("low_confidence_skipped"),
        F.count_if(attack & sure & F.col("listed")).alias("whitelist_skipped"),
        F.count_if(attack & sure & ~F.col("listed")).alias("_passed"),
    )
    kept = new_alerts(scored, allow_list, threshold, window_us, levels).agg(
        F.count(F.lit(1)).alias("alerts_created"), *class_counts(ATTACK_CLASSES)
    )
    # Both sides are one row.
    return before.join(F.broadcast(kept), F.lit(True)).select(
        "total_predictions", "benign_filtered", "low_confidence_skipped", "whitelist_skipped",
        (F.col("_passed") - F.col("alerts_created")).alias("duplicates_blocked"),
        "alerts_created", *[c for c in kept.columns if c != "alerts_created"],
    )
