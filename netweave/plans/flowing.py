"""Queries over packets and flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweave.constants import EVICTION_COUNT, FLOW_TIMEOUT_US
from netweave.operators import clean, flows, packets, prep
from netweave.plans.registry import query
from netweave.sources import views
from netweave.sources.views import AS_OF_US, FLOW_KEYS, FLOW_NUMERIC, PACKETS, RAW_FLOWS, WIDE_GAP_US

GAP = WIDE_GAP_US
KEYS = "lo_ip, lo_port, hi_ip, hi_port, protocol"

KEYED = f"""
keyed as (
 select p.*,
  case when src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port) then 0 else 1 end side
 from ({PACKETS}) p),
cornered as (
 select *,
  case when side=0 then src_ip else dst_ip end lo_ip, case when side=0 then src_port else dst_port end lo_port,
  case when side=0 then dst_ip else src_ip end hi_ip, case when side=0 then dst_port else src_port end hi_port
 from keyed),
stepped as (
 select *, case when ts_us - lag(ts_us) over (partition by {KEYS} order by ts_us, pkt_seq) < {GAP} then 0 else 1 end opens
 from cornered),
numbered as (
 select *, cast(sum(opens) over (partition by {KEYS} order by ts_us, pkt_seq) as bigint) segment
 from stepped),
led as (
 select *,
  first_value(side) over w lead, min(ts_us) over (partition by {KEYS}, segment) start_us,
  ts_us - lag(ts_us) over w iat_us
 from numbered window w as (partition by {KEYS}, segment order by ts_us, pkt_seq)),
directed as (
 select *, side = lead is_forward,
  ts_us - lag(ts_us) over (partition by {KEYS}, segment, side order by ts_us, pkt_seq) side_iat_us
 from led)
"""

FLOWS = f"""
with {KEYED},
summed as (
 select {KEYS}, segment, min(lead) lead,
  min(ts_us) start_us, max(ts_us) end_us, max(ts_us) - min(ts_us) duration_us,
  count(*) total_packets, count(*) filter (is_forward) fwd_packets, count(*) filter (not is_forward) bwd_packets,
  cast(sum(packet_length) as bigint) all_bytes,
  cast(coalesce(sum(packet_length) filter (is_forward), 0) as bigint) fwd_bytes,
  cast(coalesce(sum(packet_length) filter (not is_forward), 0) as bigint) bwd_bytes,
  max(packet_length) filter (is_forward) fwd_max,
  cast(coalesce(sum(header_length) filter (is_forward), 0) as bigint) fwd_header,
  cast(coalesce(sum(header_length) filter (not is_forward), 0) as bigint) bwd_header,
  cast(sum(case when tcp_flags & 8 > 0 then 1 else 0 end) as bigint) psh,
  cast(sum(case when tcp_flags & 16 > 0 then 1 else 0 end) as bigint) ack,
  arg_min(tcp_window, ts_us) filter (is_forward) fwd_win,
  arg_min(tcp_window, ts_us) filter (not is_forward) bwd_win,
  max(ts_us) filter (is_forward) - min(ts_us) filter (is_forward) fwd_span,
  stddev_pop(iat_us) gap_std, stddev_pop(side_iat_us) filter (is_forward) fwd_gap_std
 from directed group by {KEYS}, segment),
flows as (
 select *,
  case when lead=0 then lo_ip else hi_ip end src_ip, case when lead=0 then hi_ip else lo_ip end dst_ip,
  case when lead=0 then lo_port else hi_port end src_port, case when lead=0 then hi_port else lo_port end dst_port
 from summed),
named as (
 select *, concat(src_ip, ':', src_port, '->', dst_ip, ':', dst_port, '-', protocol) flow_id from flows)
"""


@query("packet_scan", f"select * from ({PACKETS}) p where protocol in ('TCP','UDP','ICMP')")
def packet_scan(spark, folder):
    return packets.captured(views.packets(spark, folder))


@query("packet_decode", f"""
select pkt_seq, ts_us, src_ip, dst_ip, src_port, dst_port, protocol, packet_length, header_length,
 case when tcp_flags & 1 > 0 then 1 else 0 end fin, case when tcp_flags & 2 > 0 then 1 else 0 end syn,
 case when tcp_flags & 4 > 0 then 1 else 0 end rst, case when tcp_flags & 8 > 0 then 1 else 0 end psh,
 case when tcp_flags & 16 > 0 then 1 else 0 end ack, case when tcp_flags & 32 > 0 then 1 else 0 end urg,
 tcp_window
from ({PACKETS}) p""")
def packet_decode(spark, folder):
    return packets.decode(views.packets(spark, folder))


@query("flow_key", f"with {KEYED} select pkt_seq, {KEYS}, side from cornered")
def flow_key(spark, folder):
    return packets.with_flow_key(views.packets(spark, folder)).select("pkt_seq", *packets.KEY, "side")


@query("flow_id", f"""
select pkt_seq, concat(src_ip, ':', src_port, '->', dst_ip, ':', dst_port, '-', protocol) flow_id
from ({PACKETS}) p""")
def flow_id(spark, folder):
    return packets.with_flow_name(views.packets(spark, folder)).select("pkt_seq", "flow_id")


def flow_rows(spark, folder):
    return flows.flows(views.packets(spark, folder), GAP)


@query("flow_features", FLOWS + """
select flow_id, segment, src_ip, dst_ip, src_port, dst_port, protocol, start_us, end_us, duration_us,
 total_packets, fwd_packets, bwd_packets,
 fwd_bytes / fwd_packets avg_fwd_segment_size, fwd_bytes / fwd_packets fwd_packet_length_mean,
 cast(fwd_max as double) fwd_packet_length_max,
 cast(fwd_bytes as double) subflow_fwd_bytes, cast(fwd_bytes as double) total_length_of_fwd_packets,
 all_bytes / total_packets packet_length_mean, all_bytes / total_packets average_packet_size,
 case when bwd_packets > 0 then bwd_bytes / bwd_packets else 0.0 end bwd_packet_length_mean,
 case when bwd_packets > 0 then bwd_bytes / bwd_packets else 0.0 end avg_bwd_segment_size,
 case when fwd_packets > 1 then fwd_span / (fwd_packets - 1) else 0.0 end fwd_iat_mean,
 cast(fwd_packets as double) total_fwd_packets, cast(fwd_packets as double) subflow_fwd_packets,
 cast(fwd_win as double) init_win_bytes_forward, cast(psh as double) psh_flag_count,
 cast(fwd_header as double) fwd_header_length, cast(bwd_bytes as double) subflow_bwd_bytes,
 round(coalesce(fwd_gap_std, 0.0), 0) fwd_iat_std, cast(dst_port as double) destination_port,
 cast(bwd_bytes as double) total_length_of_bwd_packets, cast(duration_us as double) flow_duration,
 case when duration_us > 0 then all_bytes * 1000000 / duration_us else 0.0 end flow_bytes_s,
 cast(bwd_header as double) bwd_header_length, round(coalesce(gap_std, 0.0), 0) flow_iat_std,
 cast(coalesce(bwd_win, 0) as double) init_win_bytes_backward, cast(ack as double) ack_flag_count
from named""")
def flow_features(spark, folder):
    found = flows.snake_features(flows.with_features(flow_rows(spark, folder)))
    return found.withColumns({c: F.round(c, 0) for c in ("fwd_iat_std", "flow_iat_std")})


@query("flow_summary", FLOWS + f"select {', '.join(flows.SUMMARY)} from named")
def flow_summary(spark, folder):
    return flow_rows(spark, folder).select(*flows.SUMMARY)


@query("flow_sessions", f"with {KEYED} select pkt_seq, {KEYS}, segment, start_us, is_forward from directed")
def flow_sessions(spark, folder):
    found = flows.packet_flows(views.packets(spark, folder), GAP)
    return found.select("pkt_seq", *packets.KEY, "segment", "start_us", "is_forward")


@query("flow_iat", f"with {KEYED} select pkt_seq, segment, iat_us, side_iat_us from directed")
def flow_iat(spark, folder):
    found = flows.packet_flows(views.packets(spark, folder), GAP)
    return found.select("pkt_seq", "segment", "iat_us", "side_iat_us")


#: Counters are taken a day before the end, so that some flows are still open.
COUNTED_AT_US = AS_OF_US - 24 * 3_600_000_000


@query("flow_counters", FLOWS + f"""
select count(*) filter (end_us + {GAP} > {COUNTED_AT_US}) active_flows, count(*) total_flows_created,
 count(*) filter (end_us + {GAP} <= {COUNTED_AT_US}) total_flows_expired,
 cast(sum(total_packets) as bigint) total_packets_processed
from named""")
def flow_counters(spark, folder):
    return flows.flow_counters(flow_rows(spark, folder), COUNTED_AT_US, GAP)


@query("oldest_flows", FLOWS + f"""
select flow_id, segment, start_us, total_packets from named
order by start_us, flow_id, segment limit {EVICTION_COUNT}""")
def oldest_flows(spark, folder):
    found = flows.oldest_flows(flow_rows(spark, folder))
    return found.select("flow_id", "segment", "start_us", "total_packets")


@query("flow_features_short_timeout", FLOWS.replace(str(GAP), str(FLOW_TIMEOUT_US)) + """
select flow_id, segment, start_us, duration_us, total_packets, fwd_packets, bwd_packets,
 round(coalesce(gap_std, 0.0), 0) flow_iat_std from named""")
def flow_features_short_timeout(spark, folder):
    """The same flows with the usual timeout of 5 s."""
    found = flows.snake_features(flows.with_features(flows.flows(views.packets(spark, folder))))
    return found.select("flow_id", "segment", "start_us", "duration_us", "total_packets", "fwd_packets",
                        "bwd_packets", F.round("flow_iat_std", 0).alias("flow_iat_std"))


@query("invalid_features", f"""
select {', '.join(FLOW_KEYS)} from ({RAW_FLOWS}) r where {' or '.join(f'{c} is null' for c in FLOW_NUMERIC)}""")
def invalid_features(spark, folder):
    return clean.invalid_rows(views.raw_flows(spark, folder), FLOW_NUMERIC).select(*FLOW_KEYS)


@query("scorable_features", f"""
select {', '.join(FLOW_KEYS)} from ({RAW_FLOWS}) r
where {' and '.join(f'{c} is not null and isfinite(cast({c} as double))' for c in FLOW_NUMERIC)}""")
def scorable_features(spark, folder):
    return clean.scorable_rows(views.raw_flows(spark, folder), FLOW_NUMERIC).select(*FLOW_KEYS)


@query("feature_vector", f"""
select {', '.join(FLOW_KEYS)},
 {', '.join(f'case when {c} is not null and isfinite(cast({c} as double)) then cast({c} as double) else 0.0 end v{i}'
            for i, c in enumerate(FLOW_NUMERIC, 1))}
from ({RAW_FLOWS}) r""")
def feature_vector(spark, folder):
    from pyspark.ml.functions import vector_to_array

    found = prep.feature_vector(views.raw_flows(spark, folder), FLOW_NUMERIC)
    found = found.withColumn("values", vector_to_array("features"))
    return found.select(*FLOW_KEYS, *[F.col("values")[i].alias(f"v{i + 1}") for i in range(len(FLOW_NUMERIC))])
