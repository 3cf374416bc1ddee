"""Search, paging, counts, rankings and timelines over the alert table.

Nothing reads the clock: the moment of a report is a parameter.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.constants import (
    ATTACK_CLASSES, AUTO_BLOCK_HOURS, AUTO_BLOCK_THRESHOLD, DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE,
    TIMELINE_PERIODS,
)
from netweave.functions.scalars import iso_text, micros

HOUR_US = 3_600_000_000


def _snake(name: str) -> str:
    return name.lower().replace(" ", "_")


def class_counts(classes=ATTACK_CLASSES) -> list[Column]:
    return [F.count_if(F.col("attack_type") == c).alias(_snake(c)) for c in classes]


def _moment(alerts: DataFrame, at: datetime) -> Column:
    """A constant of the time column's own type, so that the filter reaches the files."""
    return F.lit(at.isoformat(sep=" ")).cast(alerts.schema["ts"].dataType)


def search(alerts: DataFrame, attack_type: str | None = None, severity: str | None = None,
           source_ip: str | None = None, start: datetime | None = None,
           end: datetime | None = None) -> DataFrame:
    """Alerts that meet every given condition; both ends of the time range count."""
    if attack_type:
        alerts = alerts.where(F.col("attack_type") == attack_type)
    if severity:
        alerts = alerts.where(F.col("severity") == severity)
    if source_ip:
        alerts = alerts.where(F.col("source_ip") == source_ip)
    if start:
        alerts = alerts.where(F.col("ts") >= _moment(alerts, start))
    if end:
        alerts = alerts.where(F.col("ts") <= _moment(alerts, end))
    return alerts


def newest_first(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc("ts_us"), F.desc("id"))


def page(found: DataFrame, number: int = 1, limit: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One page, newest alerts first."""
    if number < 1 or not 1 <= limit <= MAX_PAGE_SIZE:
        raise ValueError(f"pages start at 1 and hold 1 to {MAX_PAGE_SIZE} alerts")
    return newest_first(found).offset((number - 1) * limit).limit(limit)


def page_meta(found: DataFrame, number: int = 1, limit: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Total of the same search, number of pages, and whether there are neighbours."""
    totals = found.agg(F.count(F.lit(1)).alias("total"))
    pages = F.greatest(F.ceil(F.col("total") / limit), F.lit(1)).cast("long")
    return totals.select(
        "total",
        F.lit(number).cast("long").alias("page"),
        F.lit(limit).cast("long").alias("page_limit"),
        pages.alias("pages"),
        (F.lit(number) < pages).alias("has_next"),
        F.lit(number > 1).alias("has_prev"),
    )


def recent(alerts: DataFrame, limit: int = 10) -> DataFrame:
    return newest_first(alerts).limit(limit)


def from_source(alerts: DataFrame, source_ip: str, limit: int = 100) -> DataFrame:
    return newest_first(search(alerts, source_ip=source_ip)).limit(limit)


def by_id(alerts: DataFrame, alert_id: int) -> DataFrame:
    return alerts.where(F.col("id") == alert_id)


def count(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("alerts"))


def overview(alerts: DataFrame) -> DataFrame:
    """Totals by class and by severity in one pass."""
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("severity") == "critical").alias("critical_alerts"),
        F.count_if(F.col("severity") == "low").alias("low_alerts"),
        *class_counts(),
    )


def last_hours(alerts: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Totals since ``hours`` before the moment; whatever is not critical is low."""
    critical = F.count_if(F.col("severity") == "critical")
    return search(alerts, start=as_of - timedelta(hours=hours)).agg(
        F.count(F.lit(1)).alias("total_alerts"),
        critical.alias("critical_alerts"),
        (F.count(F.lit(1)) - critical).alias("low_alerts"),
        *class_counts(),
        F.lit(hours).cast("long").alias("time_period_hours"),
    )


def top_targets(alerts: DataFrame, limit: int = 10) -> DataFrame:
    return (
        alerts.groupBy("dest_ip")
        .agg(F.count(F.lit(1)).alias("attack_count"))
        .orderBy(F.desc("attack_count"), "dest_ip")
        .limit(limit)
    )


def timeline(alerts: DataFrame, as_of: datetime, period: str = "hour") -> DataFrame:
    """Counts per interval, empty ones included.

    Intervals start at ``as_of`` minus the period, and one more starts at ``as_of``
    itself. Alerts meet their interval by arithmetic; the list of intervals has at
    most 25 rows.
    """
    hours, minutes = TIMELINE_PERIODS[period]
    start, width = as_of - timedelta(hours=hours), minutes * 60_000_000
    start_us, buckets = micros(start), hours * 60 // minutes + 1
    bucket = F.floor((F.col("ts_us") - start_us) / width).cast("long")
    counted = (
        search(alerts, start=start)
        .withColumn("bucket", bucket)
        .where(F.col("bucket") < buckets)
        .groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("total"),
            *class_counts(),
            F.count_if(F.col("severity") == "critical").alias("critical"),
            F.count_if(F.col("severity") == "low").alias("low"),
        )
    )
    grid = alerts.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    begin = F.lit(start_us) + F.col("bucket") * width
    return grid.join(F.broadcast(counted), "bucket", "left").select(
        "bucket",
        begin.alias("start_us"),
        iso_text(begin).alias("start_time"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counted.columns if c != "bucket"],
    )


def timeline_summary(alerts: DataFrame, as_of: datetime, period: str = "hour") -> DataFrame:
    """Totals of the period; alerts later than ``as_of`` count here too."""
    hours, minutes = TIMELINE_PERIODS[period]
    critical = F.count_if(F.col("severity") == "critical")
    return search(alerts, start=as_of - timedelta(hours=hours)).agg(
        F.lit(period).alias("period"),
        F.lit(minutes).cast("long").alias("interval_minutes"),
        F.count(F.lit(1)).alias("total_alerts"),
        critical.alias("critical_alerts"),
        (F.count(F.lit(1)) - critical).alias("low_alerts"),
    )


def as_json(alerts: DataFrame) -> DataFrame:
    """One JSON text per alert, as sent to listeners."""
    return alerts.select(
        "id",
        F.to_json(
            F.struct(
                "source_ip", "dest_ip", "attack_type", "confidence", "severity",
                iso_text(F.col("ts_us")).alias("timestamp"), "id",
            )
        ).alias("message"),
    )


def auto_block(alerts: DataFrame, threshold: int = AUTO_BLOCK_THRESHOLD,
               hours: int = AUTO_BLOCK_HOURS) -> DataFrame:
    """Sources with enough critical alerts and when a block after the last one ends."""
    return (
        alerts.where(F.col("severity") == "critical")
        .groupBy("source_ip")
        .agg(F.count(F.lit(1)).alias("critical_alerts"), F.max("ts_us").alias("last_us"))
        .where(F.col("critical_alerts") >= threshold)
        .select("source_ip", "critical_alerts", (F.col("last_us") + hours * HOUR_US).alias("blocked_until_us"))
    )


def retained(alerts: DataFrame, as_of: datetime, days: int = 0) -> DataFrame:
    """Alerts young enough to keep; 0 days keeps all."""
    return search(alerts, start=as_of - timedelta(days=days)) if days > 0 else alerts
