"""Packet records: protocol filter, decoding, flow keys and flow names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.constants import CAPTURED_PROTOCOLS, TCP_FLAG_BITS
from netweave.functions.scalars import flag_set

KEY = ["lo_ip", "lo_port", "hi_ip", "hi_port", "protocol"]


def captured(packets: DataFrame, protocols=CAPTURED_PROTOCOLS) -> DataFrame:
    """Keep the protocols that are listened to."""
    return packets.where(F.col("protocol").isin(list(protocols)))


def header_length(protocol: Column, ip_words: Column, tcp_words: Column) -> Column:
    """IP header plus transport header in bytes; header sizes come in 32-bit words."""
    return ip_words * 4 + (
        F.when(protocol == "TCP", tcp_words * 4)
        .when(protocol.isin("UDP", "ICMP"), F.lit(8))
        .otherwise(F.lit(0))
    )


def decode(packets: DataFrame) -> DataFrame:
    """One 0/1 column per TCP flag; flags and window are 0 for other protocols."""
    tcp = F.col("protocol") == "TCP"
    return packets.select(
        "pkt_seq", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        "packet_length", "header_length",
        *[
            F.when(tcp, flag_set(F.col("tcp_flags"), bit)).otherwise(F.lit(0)).alias(name)
            for name, bit in TCP_FLAG_BITS.items()
        ],
        F.when(tcp, F.col("tcp_window")).otherwise(F.lit(0)).alias("tcp_window"),
    )


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Drop records without addresses and add the undirected key.

    Both directions of a conversation get the same ``KEY`` columns; ``side`` is
    0 when the packet was sent by the ``lo`` endpoint. For ICMP the port columns
    hold type and code, for other protocols without ports they count as 0.
    """
    has_ports = F.col("protocol").isin("TCP", "UDP", "ICMP")
    known = packets.where(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
    known = known.withColumns(
        {
            "src_port": F.when(has_ports, F.col("src_port")).otherwise(F.lit(0)),
            "dst_port": F.when(has_ports, F.col("dst_port")).otherwise(F.lit(0)),
        }
    )
    from_lo = (F.col("src_ip") < F.col("dst_ip")) | (
        (F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") <= F.col("dst_port"))
    )
    return known.withColumns(
        {
            "lo_ip": F.when(from_lo, F.col("src_ip")).otherwise(F.col("dst_ip")),
            "lo_port": F.when(from_lo, F.col("src_port")).otherwise(F.col("dst_port")),
            "hi_ip": F.when(from_lo, F.col("dst_ip")).otherwise(F.col("src_ip")),
            "hi_port": F.when(from_lo, F.col("dst_port")).otherwise(F.col("src_port")),
            "side": F.when(from_lo, 0).otherwise(1),
        }
    )


def flow_name(src_ip, src_port, dst_ip, dst_port, protocol) -> Column:
    """``src:sport->dst:dport-PROTO``."""
    return F.concat(
        src_ip, F.lit(":"), src_port.cast("string"), F.lit("->"),
        dst_ip, F.lit(":"), dst_port.cast("string"), F.lit("-"), protocol,
    )


def with_flow_name(packets: DataFrame) -> DataFrame:
    names = [F.col(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")]
    return packets.withColumn("flow_id", flow_name(*names))
