"""Streaming versions of flow assembly, duplicate suppression, detection, timelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.constants import ALERT_THRESHOLD, ATTACK_CLASSES, DEDUP_WINDOW_US, FLOW_TIMEOUT_US
from netweave.operators import alerts, cascade, dedup, flows
from netweave.operators.packets import KEY, with_flow_key
from netweave.operators.training import Classifier, FixedRule
from netweave.streaming.carry import CarryStream, Step
from netweave.streaming.suppress import suppressed

ListSource = Callable[[], DataFrame]


def flow_step(timeout_us: int = FLOW_TIMEOUT_US) -> Step:
    """Merge new pieces with open flows; a flow is done once the watermark is a timeout past it."""
    def step(rows: DataFrame, state: DataFrame | None, mark: int | None) -> DataFrame:
        pieces = flows.flow_pieces(rows, timeout_us)
        if state is not None:
            pieces = pieces.unionByName(state)
        merged = flows.merge_pieces(pieces, timeout_us).drop("segment")
        still = F.lit(False) if mark is None else (F.col("last_us") + timeout_us > mark)
        return merged.withColumn("_open", still)
    return step


def finished_flows(pieces: DataFrame) -> DataFrame:
    return flows.oriented(pieces.withColumn("segment", F.lit(None).cast("long")))


def stream_flows(spark: SparkSession, packets: DataFrame, path: str, delay_us: int,
                 timeout_us: int = FLOW_TIMEOUT_US) -> CarryStream:
    """Packets to flows; ``finished_flows(job.output())`` has the closed ones."""
    job = CarryStream(spark, path, "ts_us", delay_us, flow_step(timeout_us))
    job.run_available(packets)
    return job


def dedup_step(keys: list[str], time: str, tie: str, window_us: int = DEDUP_WINDOW_US,
               levels: int | None = None) -> Step:
    """Kept rows go out; per key the last kept time is carried until it no longer matters."""
    def step(rows: DataFrame, state: DataFrame | None, mark: int | None) -> DataFrame:
        previous = None if state is None else state.select(*keys, F.col(time).alias("last_kept"))
        kept = dedup.kept_moments(rows, keys, time, tie, window_us, levels, previous)
        out = dedup.same_rows(rows, kept, [*keys, time, tie])
        if mark is None:
            return out.withColumn("_open", F.lit(False))
        known = kept.select(*keys, time)
        if state is not None:
            known = known.unionByName(state.select(*keys, time))
        carried = known.groupBy(*keys).agg(F.max(time).alias(time)).where(F.col(time) > mark - window_us)
        return out.withColumn("_open", F.lit(False)).unionByName(
            carried.withColumn("_open", F.lit(True)), allowMissingColumns=True
        )
    return step


def stream_dedup(candidates: DataFrame, path: str, delay_us: int, window_us: int = DEDUP_WINDOW_US) -> DataFrame:
    """The rows that duplicate suppression keeps of an endless table, by the engine's state and timers.

    A row is written once the watermark has passed it; an ``end_mark`` ends all.
    """
    return appended(suppressed(candidates, cascade.ALERT_KEY, "ts_us", "id", window_us, delay_us), path)


def stream_detect(spark: SparkSession, packets: DataFrame, path: str, delay_us: int,
                  model: Classifier | FixedRule, allow_list: ListSource, timeout_us: int = FLOW_TIMEOUT_US,
                  threshold: float = ALERT_THRESHOLD, window_us: int = DEDUP_WINDOW_US) -> DataFrame:
    """Packets to alerts: flows, scores, filters, duplicate suppression.

    A flow's alert bears the moment the flow ended for good. Flows of a batch end
    later than those of earlier batches, so the alerts are deduplicated in order.
    The allow list is read anew for every batch. Alerts also go out as JSON lines.
    """
    by_time = dedup_step(cascade.ALERT_KEY, "ts_us", "id", window_us, levels=1)
    kept_path = f"{path}/kept"

    def on_flows(pieces: DataFrame, batch: int) -> None:
        ready = flows.with_features(finished_flows(pieces))
        scored = model.score_valid(ready).select(
            (F.col("end_us") + timeout_us).alias("ts_us"), F.xxhash64("flow_id", "start_us").alias("id"),
            F.col("src_ip").alias("source_ip"), F.col("dst_ip").alias("dest_ip"),
            "attack_type", "confidence",
        )
        passed = cascade.candidates(scored, allow_list(), threshold)
        passed.write.mode("overwrite").parquet(f"{path}/passed/batch={batch}")
        passed = spark.read.schema(passed.schema).parquet(f"{path}/passed/batch={batch}")
        state = None
        if batch > 0:
            state = spark.read.parquet(f"{kept_path}/batch={batch - 1}").where("_open").drop("_open")
        # The horizon of this batch is not needed to keep state exact; old entries
        # are dropped once they are a window behind the newest alert.
        newest = passed.agg(F.max("ts_us")).first()[0]
        mark = newest if newest is not None else 0
        result = by_time(passed, state, mark)
        result.write.mode("overwrite").parquet(f"{kept_path}/batch={batch}")
        fresh = spark.read.parquet(f"{kept_path}/batch={batch}").where(~F.col("_open")).drop("_open")
        alerts.as_json(cascade.with_severity(fresh)).select("message").write.mode("overwrite").text(
            f"{path}/messages/batch={batch}")

    job = CarryStream(spark, f"{path}/flows", "ts_us", delay_us, flow_step(timeout_us), after=on_flows)
    job.run_available(packets)
    done = [r["batch"] for r in job.notes().select("batch").collect()]
    kept = spark.read.parquet(*[f"{kept_path}/batch={b}" for b in done]).where(~F.col("_open")).drop("_open")
    return cascade.with_severity(kept)


def appended(flat: DataFrame, path: str) -> DataFrame:
    """Run a stream over what is there and read what it appended."""
    query = (
        flat.writeStream.outputMode("append").format("parquet")
        .option("path", f"{path}/out").option("checkpointLocation", f"{path}/offsets")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return flat.sparkSession.read.schema(flat.schema).parquet(f"{path}/out")


def stream_sessions(packets: DataFrame, path: str, delay_us: int, gap_us: int = FLOW_TIMEOUT_US) -> DataFrame:
    """Flow totals over an endless table of packets, by the engine's session windows and state.

    A flow is written once the watermark is a timeout past its last packet; an
    ``end_mark`` ends all. What needs neighbouring packets is left to ``stream_flows``.
    """
    rows = with_flow_key(packets).withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", f"{delay_us} microseconds")
    summed = rows.groupBy(F.session_window("at", f"{gap_us} microseconds"), *KEY).agg(
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("pkt_seq").alias("total_packets"),
        F.sum("packet_length").alias("all_bytes"), F.min_by("side", F.struct("ts_us", "pkt_seq")).alias("lead"),
        F.count_if(F.col("side") == 0).alias("low_side_packets"),
    )
    return appended(summed.drop("session_window").where("total_packets > 0"), path)


def end_mark(last_us: int, delay_us: int, width_us: int, schema: T.StructType, time: str = "ts_us"):
    """A row without id far enough ahead that every interval up to ``last_us`` is over.

    Its texts are empty, not null: records without addresses never reach the watermark.
    """
    moment = last_us + delay_us + 2 * width_us
    return tuple(moment if f.name == time else "" if isinstance(f.dataType, T.StringType) else None for f in schema)


def stream_timeline(spark: SparkSession, stored: DataFrame, path: str, delay: str, width: str) -> DataFrame:
    """Counts per interval over an endless table of alerts; an interval is written when it is over.

    Rows without an id only move the watermark: an ``end_mark`` closes the last intervals,
    and its own interval never ends.
    """
    counted = (
        stored.withColumn("at", F.timestamp_micros("ts_us"))
        .withWatermark("at", delay)
        .groupBy(F.window("at", width))
        .agg(
            F.count("id").alias("total"),
            *alerts.class_counts(ATTACK_CLASSES),
            F.count_if(F.col("severity") == "critical").alias("critical"),
            F.count_if(F.col("severity") == "low").alias("low"),
        )
    )
    flat = counted.select(F.unix_micros("window.start").alias("start_us"), *counted.columns[1:]).where("total > 0")
    return appended(flat, path)
