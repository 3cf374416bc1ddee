"""Packets to bidirectional flows and the 25 model inputs of each flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.constants import EVICTION_COUNT, FLOW_TIMEOUT_US, MODEL_FEATURES, TCP_FLAG_BITS
from netweave.functions.scalars import col_of, flag_set, ratio
from netweave.operators.packets import KEY, flow_name, with_flow_key
from netweave.operators.sessions import SPAN_US, assign_sessions, with_span

# Gaps are squared and summed as whole numbers, so partial sums can be merged in
# any order with the same result. A gap is cut into a high and a low part of 16
# bits; the three sums below stay within a long for flows of up to two years.
_LOW = 65_536
_SUMS = ("hh", "hl", "ll")


def _gap_parts(gap: Column) -> dict[str, Column]:
    high, low = F.shiftright(gap, 16), gap % _LOW
    return {"hh": high * high, "hl": high * low, "ll": low * low}


def _spread(parts: str, total: Column, gaps: Column) -> Column:
    """Population standard deviation from the exact sum of squares."""
    wide = "decimal(38,0)"
    square_sum = (
        F.col(f"{parts}_hh").cast(wide) * F.lit(_LOW).cast("decimal(6,0)") * F.lit(_LOW).cast("decimal(6,0)")
        + F.col(f"{parts}_hl").cast(wide) * F.lit(2 * _LOW).cast("decimal(7,0)")
        + F.col(f"{parts}_ll").cast(wide)
    ).cast(wide)
    total = total.cast("decimal(19,0)")
    scaled = (gaps.cast("decimal(12,0)") * square_sum).cast(wide) - (total * total).cast(wide)
    return F.when(gaps > 0, F.sqrt(scaled.cast("double")) / gaps).otherwise(F.lit(0.0))


def flow_pieces(
    packets: DataFrame, timeout_us: int = FLOW_TIMEOUT_US, span_us: int = SPAN_US
) -> DataFrame:
    """One row per unbroken run of packets of a key within a span of time.

    Pieces hold only sums, counts and extremes, per sender side, and can be merged.
    This is the only shuffle of packet rows.
    """
    rows = with_span(with_flow_key(packets), "ts_us", span_us)
    cell = [*KEY, "_span"]
    order = Window.partitionBy(*cell).orderBy("ts_us", "pkt_seq")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = {s: F.col("side") == s for s in (0, 1)}

    rows = rows.withColumn("_prev", F.lag("ts_us").over(order))
    rows = rows.withColumn(
        "_new", F.col("_prev").isNull() | (F.col("ts_us") - F.col("_prev") >= timeout_us)
    )
    rows = rows.withColumns(
        {
            "_no": F.sum(F.col("_new").cast("long")).over(upto),
            "_start": F.max(F.when(F.col("_new"), F.col("ts_us"))).over(upto),
            "_last0": F.max(F.when(own[0], F.col("ts_us"))).over(before),
            "_last1": F.max(F.when(own[1], F.col("ts_us"))).over(before),
        }
    )
    same_side = F.when(own[0], F.col("_last0")).otherwise(F.col("_last1"))
    rows = rows.withColumns(
        {
            "_gap": F.when(~F.col("_new"), F.col("ts_us") - F.col("_prev")),
            "_sgap": F.when(same_side >= F.col("_start"), F.col("ts_us") - same_side),
        }
    )
    tcp = F.col("protocol") == "TCP"
    length, header = F.col("packet_length"), F.col("header_length")
    aggs = [
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.max(F.when(F.col("_new"), F.col("side"))).alias("lead"),
        F.max(F.when(F.col("_new"), length)).alias("lead_bytes"),
        F.max(F.when(F.col("_new"), header)).alias("lead_header"),
        *[
            F.coalesce(
                F.sum(F.when(tcp, flag_set(F.col("tcp_flags"), TCP_FLAG_BITS[flag])).cast("long")),
                F.lit(0),
            ).alias(flag)
            for flag in ("psh", "ack")
        ],
        *[F.coalesce(F.sum(e), F.lit(0)).alias(f"g_{p}") for p, e in _gap_parts(F.col("_gap")).items()],
    ]
    for s in (0, 1):
        mine = lambda value, s=s: F.when(own[s], value)
        aggs += [
            F.count(mine(F.lit(1))).alias(f"n{s}"),
            F.coalesce(F.sum(mine(length).cast("long")), F.lit(0)).alias(f"bytes{s}"),
            F.coalesce(F.max(mine(length)), F.lit(0)).alias(f"max{s}"),
            F.coalesce(F.sum(mine(header).cast("long")), F.lit(0)).alias(f"header{s}"),
            F.min(mine(F.col("ts_us"))).alias(f"first{s}"),
            F.max(mine(F.col("ts_us"))).alias(f"last{s}"),
            F.max(
                F.when(own[s] & F.col("_sgap").isNull(), F.when(tcp, F.col("tcp_window")).otherwise(0))
            ).alias(f"win{s}"),
            *[
                F.coalesce(F.sum(mine(e)), F.lit(0)).alias(f"s{s}_{p}")
                for p, e in _gap_parts(F.col("_sgap")).items()
            ],
        ]
    return rows.groupBy(*cell, "_no").agg(*aggs).drop("_span", "_no")


def merge_pieces(pieces: DataFrame, timeout_us: int = FLOW_TIMEOUT_US) -> DataFrame:
    """Join pieces of a key that lie closer than the timeout; same columns, one row per flow.

    Pieces of a key are at least ``timeout_us`` or a span border apart, so their
    number per key is bounded by the time range.
    """
    order = Window.partitionBy(*KEY).orderBy("first_us")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = pieces.withColumn("_prev", F.lag("last_us").over(order))
    rows = rows.withColumn(
        "_new", F.col("_prev").isNull() | (F.col("first_us") - F.col("_prev") >= timeout_us)
    )
    rows = rows.withColumns(
        {
            "segment": F.sum(F.col("_new").cast("long")).over(upto),
            "_start": F.max(F.when(F.col("_new"), F.col("first_us"))).over(upto),
            "_last0": F.max("last0").over(before),
            "_last1": F.max("last1").over(before),
        }
    )
    bridges = {"g": F.when(~F.col("_new"), F.col("first_us") - F.col("_prev"))}
    for s in (0, 1):
        bridges[f"s{s}"] = F.when(
            F.col(f"_last{s}") >= F.col("_start"), F.col(f"first{s}") - F.col(f"_last{s}")
        )
    opening = lambda name: F.max(F.when(F.col("_new"), F.col(name))).alias(name)
    aggs = [
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        opening("lead"),
        opening("lead_bytes"),
        opening("lead_header"),
        F.sum("psh").alias("psh"),
        F.sum("ack").alias("ack"),
    ]
    for name, bridge in bridges.items():
        parts = _gap_parts(bridge)
        aggs += [
            F.sum(F.col(f"{name}_{p}") + F.coalesce(parts[p], F.lit(0))).alias(f"{name}_{p}")
            for p in _SUMS
        ]
    for s in (0, 1):
        leads_side = F.col(f"first{s}").isNotNull() & (
            F.col(f"_last{s}").isNull() | (F.col(f"_last{s}") < F.col("_start"))
        )
        aggs += [
            F.sum(f"n{s}").alias(f"n{s}"),
            F.sum(f"bytes{s}").alias(f"bytes{s}"),
            F.max(f"max{s}").alias(f"max{s}"),
            F.sum(f"header{s}").alias(f"header{s}"),
            F.min(f"first{s}").alias(f"first{s}"),
            F.max(f"last{s}").alias(f"last{s}"),
            F.max(F.when(leads_side, F.col(f"win{s}"))).alias(f"win{s}"),
        ]
    return rows.groupBy(*KEY, "segment").agg(*aggs)


def oriented(flows: DataFrame, icmp_literal: bool = True) -> DataFrame:
    """Turn lo/hi sides into forward and backward; the first packet points forward.

    With ``icmp_literal`` an ICMP flow whose type or code is not 0 has only its
    first packet forward, since its direction is tested with ports 0/0.
    """
    lo_leads = F.col("lead") == 0
    pick = lambda a, b: F.when(lo_leads, F.col(a)).otherwise(F.col(b))
    both = flows.select(
        *KEY,
        "segment",
        pick("lo_ip", "hi_ip").alias("src_ip"),
        pick("hi_ip", "lo_ip").alias("dst_ip"),
        pick("lo_port", "hi_port").alias("src_port"),
        pick("hi_port", "lo_port").alias("dst_port"),
        F.col("first_us").alias("start_us"),
        F.col("last_us").alias("end_us"),
        (F.col("last_us") - F.col("first_us")).alias("duration_us"),
        (F.col("n0") + F.col("n1")).alias("total_packets"),
        (F.col("bytes0") + F.col("bytes1")).alias("total_bytes"),
        (F.col("header0") + F.col("header1")).alias("total_header"),
        *["psh", "ack", "lead_bytes", "lead_header"],
        *[f"g_{p}" for p in _SUMS],
        *[
            pick(f"{name}0", f"{name}1").alias(f"fwd_{name}")
            for name in ("n", "bytes", "max", "header", "win", "first", "last")
        ],
        F.coalesce(pick("win1", "win0"), F.lit(0)).alias("bwd_win"),
        *[pick(f"s0_{p}", f"s1_{p}").alias(f"f_{p}") for p in _SUMS],
    )
    if not icmp_literal:
        only_first = F.lit(False)
    else:
        only_first = (F.col("protocol") == "ICMP") & (
            (F.col("src_port") != 0) | (F.col("dst_port") != 0)
        )
    first_or = lambda value, name: F.when(only_first, value).otherwise(F.col(name))
    return both.withColumns(
        {
            "fwd_packets": first_or(F.lit(1), "fwd_n").cast("long"),
            "fwd_bytes": first_or(F.col("lead_bytes"), "fwd_bytes").cast("long"),
            "fwd_max": first_or(F.col("lead_bytes"), "fwd_max").cast("long"),
            "fwd_header": first_or(F.col("lead_header"), "fwd_header").cast("long"),
            "fwd_span": first_or(F.lit(0), "fwd_last") - first_or(F.lit(0), "fwd_first"),
        }
    ).withColumns(
        {
            "bwd_packets": F.col("total_packets") - F.col("fwd_packets"),
            "bwd_bytes": F.col("total_bytes") - F.col("fwd_bytes"),
            "bwd_header": F.col("total_header") - F.col("fwd_header"),
            "flow_id": flow_name(
                F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("protocol")
            ),
        }
    )


SUMMARY = ["flow_id", "segment", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
           "start_us", "end_us", "duration_us", "total_packets", "fwd_packets", "bwd_packets"]


def flows(packets: DataFrame, timeout_us: int = FLOW_TIMEOUT_US, icmp_literal: bool = True,
          span_us: int = SPAN_US) -> DataFrame:
    """Merged, oriented flows with all sums the features need."""
    pieces = flow_pieces(packets, timeout_us, span_us)
    return oriented(merge_pieces(pieces, timeout_us), icmp_literal)


def feature_columns() -> dict[str, Column]:
    """The 25 model inputs over the columns of ``flows``, in model order."""
    c = F.col
    fwd_mean = ratio(c("fwd_bytes"), c("fwd_packets"))
    bwd_mean = ratio(c("bwd_bytes"), c("bwd_packets"))
    mean = ratio(c("total_bytes"), c("total_packets"))
    fwd_gaps = c("fwd_packets") - 1
    values = {
        " Avg Fwd Segment Size": fwd_mean,
        " Fwd Packet Length Mean": fwd_mean,
        " Fwd Packet Length Max": c("fwd_max"),
        " Subflow Fwd Bytes": c("fwd_bytes"),
        "Total Length of Fwd Packets": c("fwd_bytes"),
        " Packet Length Mean": mean,
        " Average Packet Size": mean,
        " Bwd Packet Length Mean": bwd_mean,
        " Avg Bwd Segment Size": bwd_mean,
        " Fwd IAT Mean": ratio(c("fwd_span"), fwd_gaps),
        " Total Fwd Packets": c("fwd_packets"),
        "Subflow Fwd Packets": c("fwd_packets"),
        "Init_Win_bytes_forward": c("fwd_win"),
        " PSH Flag Count": c("psh"),
        " Fwd Header Length": c("fwd_header"),
        " Subflow Bwd Bytes": c("bwd_bytes"),
        " Fwd IAT Std": _spread("f", c("fwd_span"), fwd_gaps),
        " Destination Port": c("dst_port"),
        " Total Length of Bwd Packets": c("bwd_bytes"),
        " Flow Duration": c("duration_us"),
        "Flow Bytes/s": ratio(c("total_bytes") * 1_000_000, c("duration_us")),
        " Bwd Header Length": c("bwd_header"),
        " Flow IAT Std": _spread("g", c("duration_us"), c("total_packets") - 1),
        " Init_Win_bytes_backward": c("bwd_win"),
        " ACK Flag Count": c("ack"),
    }
    return {name: values[name].cast("double") for name in MODEL_FEATURES}


def with_features(flow_rows: DataFrame) -> DataFrame:
    """The flow's identity and its 25 model inputs under their exact names."""
    return flow_rows.select(
        *SUMMARY, *[value.alias(name) for name, value in feature_columns().items()]
    )


def snake(name: str) -> str:
    """``' Fwd IAT Mean'`` to ``fwd_iat_mean``."""
    return name.strip().lower().replace("/", "_").replace(" ", "_")


def snake_features(featured: DataFrame) -> DataFrame:
    return featured.select(
        *SUMMARY, *[col_of(name).alias(snake(name)) for name in MODEL_FEATURES]
    )


def packet_flows(packets: DataFrame, timeout_us: int = FLOW_TIMEOUT_US,
                 icmp_literal: bool = True, span_us: int = SPAN_US) -> DataFrame:
    """Every packet with its flow, direction and gaps to earlier packets.

    ``iat_us`` is the gap to the previous packet of the flow, ``side_iat_us`` to the
    previous packet of the same direction; both null for a first packet.
    """
    ts = F.col("ts_us")
    icmp_pair = (F.col("protocol") == "ICMP") & ((F.col("src_port") != 0) | (F.col("dst_port") != 0))
    rows = assign_sessions(
        with_flow_key(packets), KEY, "ts_us", "pkt_seq", timeout_us,
        starts={"start_us": ts, "start_seq": F.col("pkt_seq"), "lead": F.col("side")},
        lasts={"last0": F.when(F.col("side") == 0, ts), "last1": F.when(F.col("side") == 1, ts)},
        span_us=span_us,
    )
    is_first = F.col("pkt_seq") == F.col("start_seq")
    forward = F.col("side") == F.col("lead")
    earlier = F.when(F.col("side") == 0, F.col("last0")).otherwise(F.col("last1"))
    earlier = F.when(earlier >= F.col("start_us"), earlier)
    if icmp_literal:
        # Only the first packet is forward, so every later one follows a backward
        # packet unless it comes right after the first.
        forward = F.when(icmp_pair, is_first).otherwise(forward)
        follows = F.when(F.col("prev_tie") != F.col("start_seq"), F.col("prev_time"))
        earlier = F.when(icmp_pair, follows).otherwise(earlier)
    return rows.select(
        "pkt_seq", "ts_us", "src_ip", "src_port", "dst_ip", "dst_port", *KEY,
        F.col("session_no").alias("segment"),
        "start_us",
        forward.alias("is_forward"),
        (ts - F.col("prev_time")).alias("iat_us"),
        (ts - earlier).alias("side_iat_us"),
    )


def flow_counters(flow_rows: DataFrame, as_of_us: int, timeout_us: int = FLOW_TIMEOUT_US) -> DataFrame:
    """Flows created, expired and still open at a moment, and packets seen."""
    expired = F.col("end_us") + timeout_us <= as_of_us
    return flow_rows.agg(
        F.count_if(~expired).alias("active_flows"),
        F.count(F.lit(1)).alias("total_flows_created"),
        F.count_if(expired).alias("total_flows_expired"),
        F.coalesce(F.sum("total_packets"), F.lit(0)).alias("total_packets_processed"),
    )


def oldest_flows(flow_rows: DataFrame, count: int = EVICTION_COUNT) -> DataFrame:
    """The flows that started first."""
    return flow_rows.orderBy("start_us", "flow_id", "segment").limit(count)
