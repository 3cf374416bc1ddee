"""Streaming queries: the tables replayed as files, one micro-batch each."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.operators import flows, training
from netweave.plans import flowing
from netweave.plans.detection import COLUMNS, KEPT, WINDOW, passed_rows
from netweave.plans.flowing import GAP
from netweave.plans.learning import TREES
from netweave.plans.registry import query
from netweave.session import pinned, work_path
from netweave.sources import views
from netweave.sources.views import ALERTS, ALLOW_LIST, PACKETS
from netweave.streaming import jobs
from netweave.streaming.carry import CarryStream, replay, replay_files

DAY_US = 86_400_000_000
STREAM_COLUMNS = [c for c in flows.SUMMARY if c != "segment"]


def _replayed(spark, df, purpose, parts=4, shuffled=False):
    path = work_path(spark, purpose)
    schema = replay_files(df, "ts_us", f"{path}/in", parts, shuffled)
    return replay(spark, f"{path}/in", schema), f"{path}/job"


@query("stream_flows", flowing.FLOWS + f"""
select {', '.join(STREAM_COLUMNS)}, cast(psh as double) psh_flag_count,
 round(coalesce(gap_std, 0.0), 0) flow_iat_std from named""")
def stream_flows(spark, folder):
    """Flows of a stream whose files mix two weeks each, flushed at the end."""
    stream, path = _replayed(spark, views.packets(spark, folder), "stream-flows", shuffled=True)
    job = jobs.stream_flows(spark, stream, path, delay_us=16 * DAY_US, timeout_us=GAP)
    found = flows.snake_features(flows.with_features(jobs.finished_flows(job.output())))
    return found.select(*STREAM_COLUMNS, "psh_flag_count", F.round("flow_iat_std", 0).alias("flow_iat_std"))


#: Slots of a replay with three files in which every third packet comes a file later.
SLOTS = f"""
slots as (
 select p.*, least(2, cast(floor((ts_us - lo) / w) as int) + case when pkt_seq % 3 = 0 then 1 else 0 end) slot
 from ({PACKETS}) p, (select min(ts_us) lo, (max(ts_us) - min(ts_us)) // 3 + 1 w from ({PACKETS}) b)),
marks as (select slot, max(ts_us) newest from slots group by slot)"""


@query("stream_counters", f"""
with {SLOTS}
select cast(count(*) as bigint) input_rows,
 count(*) filter (ts_us < (select max(newest) from marks m where m.slot < s.slot)) late_rows from slots s""")
def stream_counters(spark, folder):
    """Rows in and rows too late over all micro-batches, some packets coming a file late."""
    packets = views.packets(spark, folder)
    stream, path = _replayed(spark, packets, "stream-counters", parts=3, shuffled=F.col("pkt_seq") % 3 == 0)
    job = jobs.stream_flows(spark, stream, path, delay_us=0, timeout_us=GAP)
    return job.notes().agg(F.sum("input_rows").alias("input_rows"), F.sum("late_rows").alias("late_rows"))


@query("stream_late_rows", f"""
with {SLOTS}
select pkt_seq, ts_us from slots s where ts_us < (select max(newest) from marks m where m.slot < s.slot)""")
def stream_late_rows(spark, folder):
    """The packets that came behind the watermark, kept apart."""
    packets = views.packets(spark, folder)
    stream, path = _replayed(spark, packets, "stream-late", parts=3, shuffled=F.col("pkt_seq") % 3 == 0)
    job = jobs.stream_flows(spark, stream, path, delay_us=0, timeout_us=GAP)
    return job.late(packets.schema).select("pkt_seq", "ts_us")


@query("stream_flow_states", f"""
with passed as (
 select * from ({PACKETS}) p where ts_us < (select max(ts_us) - {DAY_US} from ({PACKETS}) b)),
ends as (
 select least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) a, greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) b,
  protocol, ts_us from passed),
breaks as (
 select *, case when ts_us - lag(ts_us) over w >= {GAP} or lag(ts_us) over w is null then 1 else 0 end new
 from ends window w as (partition by a, b, protocol order by ts_us)),
numbered as (select *, sum(new) over (partition by a, b, protocol order by ts_us rows unbounded preceding) no from breaks),
lasts as (select a, b, protocol, no, max(ts_us) last_us from numbered group by all)
select count(*) created, count(*) filter (last_us + {GAP} <= (select max(ts_us) - {DAY_US} from ({PACKETS}) c)) expired,
 count(*) filter (last_us + {GAP} > (select max(ts_us) - {DAY_US} from ({PACKETS}) c)) active from lasts""")
def stream_flow_states(spark, folder):
    """Flows created, expired and still active when the stream pauses."""
    stream, path = _replayed(spark, views.packets(spark, folder), "stream-states")
    job = CarryStream(spark, path, "ts_us", DAY_US, jobs.flow_step(GAP))
    job.run_available(stream, flush=False)
    counts = job.output().select(F.lit("expired").alias("s")).unionByName(job.still_open().select(F.lit("active").alias("s")))
    return counts.agg(
        F.count("*").alias("created"), F.count_if(F.col("s") == "expired").alias("expired"), F.count_if(F.col("s") == "active").alias("active"))


def _with_end(spark, df, purpose):
    """A replayed table as a stream whose last file is an end mark."""
    path = work_path(spark, purpose)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in replay_files(df, "ts_us", f"{path}/in")])
    last = df.agg(F.max("ts_us")).first()[0]
    mark = spark.createDataFrame([jobs.end_mark(last, DAY_US, DAY_US, schema)], schema)
    mark.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return replay(spark, f"{path}/in", schema), f"{path}/job"


@query("stream_dedup", f"with {KEPT} select {', '.join(COLUMNS)} from kept")
def stream_dedup(spark, folder):
    """Kept alerts of a stream, the last kept time of each key in the engine's state."""
    stream, path = _with_end(spark, passed_rows(spark, folder).select(*COLUMNS), "stream-dedup")
    return jobs.stream_dedup(stream, path, DAY_US, WINDOW)


@query("stream_sessions", flowing.FLOWS + f"""
select {flowing.KEYS}, start_us, end_us, total_packets, all_bytes, lead,
 case when lead = 0 then fwd_packets else bwd_packets end low_side_packets from summed""")
def stream_sessions(spark, folder):
    """Totals of the flows of a stream, kept by the engine's own state and watermark."""
    stream, path = _with_end(spark, views.packets(spark, folder), "stream-sessions")
    return jobs.stream_sessions(stream, path, DAY_US, GAP)


@query("stream_timeline", f"""
select cast(floor(ts_us / {DAY_US}.0) * {DAY_US} as bigint) start_us, count(*) total,
 count(*) filter (attack_type = 'DoS Hulk') dos_hulk, count(*) filter (attack_type = 'PortScan') portscan,
 count(*) filter (attack_type = 'DDoS') ddos, count(*) filter (severity = 'critical') critical,
 count(*) filter (severity = 'low') low from ({ALERTS}) a group by 1""")
def stream_timeline(spark, folder):
    """Daily counts of all days; a mark after the last alert closes the days still open."""
    columns = ["id", "ts_us", "attack_type", "severity"]
    stored = views.alerts(spark, folder).select(*columns)
    stream, path = _with_end(spark, stored, "stream-timeline")
    return jobs.stream_timeline(spark, stream, path, "1 day", "1 day")


@query("stream_detect")
def stream_detect(spark, folder):
    """Packets to alerts, with a forest that has learned the sender's kind of traffic."""
    known = flows.with_features(flowing.flow_rows(spark, folder))
    labelled = known.withColumn("label_id", F.when(F.col("protocol") == "UDP", 1).when(
        F.col("dst_port") == 443, 2).when(F.col("` Flow Duration`") > 0, 3).otherwise(0))
    labelled = pinned(labelled, "labelled-flows")
    model = training.train(labelled, list(flows.MODEL_FEATURES), rounds=TREES, part=None)
    stream, path = _replayed(spark, views.packets(spark, folder), "stream-detect")
    found = jobs.stream_detect(
        spark, stream, path, DAY_US, model, lambda: views.allow_list(spark, folder), GAP, 0.5, WINDOW)
    return found.select("ts_us", "source_ip", "dest_ip", "attack_type", "severity",
                        F.round("confidence", 6).alias("confidence"))


@query("stream_detect_rule", "with recursive" + flowing.FLOWS.strip().removeprefix("with") + f""",
scored as (
 select end_us + {GAP} ts_us, src_ip source_ip,
  case when protocol = 'UDP' then 'DoS Hulk' when dst_port = 443 then 'PortScan' when duration_us > 0 then 'DDoS' else 'BENIGN' end attack_type
 from named),
passed as (
 select distinct * from scored where attack_type <> 'BENIGN' and source_ip not in (select ip_address from ({ALLOW_LIST}) a)),
ordered as (select *, row_number() over (partition by source_ip, attack_type order by ts_us) rn from passed),
walk as (
 select ts_us, source_ip, attack_type, rn, ts_us last_kept, true kept from ordered where rn = 1
 union all
 select n.ts_us, n.source_ip, n.attack_type, n.rn,
  case when n.ts_us - w.last_kept >= {WINDOW} then n.ts_us else w.last_kept end, n.ts_us - w.last_kept >= {WINDOW}
 from walk w join ordered n on n.source_ip = w.source_ip and n.attack_type = w.attack_type and n.rn = w.rn + 1)
select ts_us, source_ip, attack_type, 'low' severity, 0.9::double confidence from walk where kept""")
def stream_detect_rule(spark, folder):
    """Packets to alerts with a fixed rule in place of a classifier, as the batch cascade has them."""
    kind = F.when(F.col("protocol") == "UDP", "DoS Hulk").when(F.col("dst_port") == 443, "PortScan").when(
        F.col("duration_us") > 0, "DDoS").otherwise("BENIGN")
    stream, path = _replayed(spark, views.packets(spark, folder), "stream-rule")
    found = jobs.stream_detect(
        spark, stream, path, 16 * DAY_US, training.FixedRule(kind), lambda: views.allow_list(spark, folder), GAP, 0.5, WINDOW)
    return found.select("ts_us", "source_ip", "attack_type", "severity", "confidence")
