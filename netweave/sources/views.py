"""Domain tables derived from the given tables.

Each view is one SQL text that Spark and the checking engine both run; only the
few words in ``DIALECTS`` differ between the two.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from netweave.functions.scalars import micros
from netweave.sources.tables import table

DIALECTS = {
    "spark": {"us": "unix_micros(cast(ts as timestamp))", "str": "string",
              "ordus": "unix_micros(cast(o_orderdate as timestamp))"},
    "duckdb": {"us": "epoch_us(ts)", "str": "varchar", "ordus": "epoch_us(o_orderdate)"},
}

#: The moment reports are made for; the events end on 2024-01-30.
AS_OF = datetime(2024, 1, 31)
AS_OF_US = micros(AS_OF)
#: Events of one user lie hours apart, so flows and duplicates use 12 h here.
WIDE_GAP_US = 12 * 3600 * 1_000_000

SOURCE_IP = "concat('10.0.',cast(floor(user_id/250) as int),'.',cast(user_id%250 as int))"

PACKETS = """
select event_id pkt_seq, {us} ts_us,
 case when event_id%3=0 then d else a end src_ip,
 case when event_id%3=0 then a else d end dst_ip,
 case when event_id%3=0 then dp else sp end src_port,
 case when event_id%3=0 then sp else dp end dst_port,
 proto protocol, cast(floor(value) as int)+40 packet_length,
 case when proto='TCP' then 40 else 28 end header_length,
 case when proto='TCP' then cast(event_id%64 as int) else 0 end tcp_flags,
 case when proto='TCP' then cast((event_id*37)%65536 as int) else 0 end tcp_window
from (select *,
  concat('10.0.',cast(floor(user_id/250) as int),'.',cast(user_id%250 as int)) a,
  concat('192.168.0.',cast(user_id%5 as int)) d,
  cast(40000+user_id%7 as int) sp,
  case cast(user_id%3 as int) when 0 then 80 when 1 then 443 else 22 end dp,
  case when event_type='error' then 'UDP' else 'TCP' end proto
 from events) z
"""

SCORED = """
select event_id id, ts, {us} ts_us,
 concat('10.0.',cast(floor(user_id/250) as int),'.',cast(user_id%250 as int)) source_ip,
 concat('192.168.0.',cast(event_id%11 as int)) dest_ip,
 case event_type when 'error' then 'DoS Hulk' when 'click' then 'PortScan'
   when 'purchase' then 'DDoS' else 'BENIGN' end attack_type,
 cast(900+(event_id*7919)%100 as double)/1000.0 confidence
from events
"""

ALERTS = f"""
select *, case when confidence >= 0.95 then 'critical' else 'low' end severity
from ({SCORED}) s where attack_type <> 'BENIGN'
"""

IP_LIST = """
select distinct
 concat('10.0.',cast(floor(user_id/250) as int),'.',cast(user_id%250 as int)) ip_address
from events where user_id%10={digit}
"""
ALLOW_LIST = IP_LIST.replace("{digit}", "0")
DENY_LIST = IP_LIST.replace("{digit}", "3")

#: A list kept with its history: one row per entry and when it was added.
LIST_ENTRIES = """
select event_id id,
 concat('10.0.',cast(floor(user_id/250) as int),'.',cast(user_id%250 as int)) ip_address,
 event_type description, {us} added_us
from events
"""

#: The log of settings writes; the newest write of a key is its value.
CONFIG_LOG = """
select event_id id, concat('limit_', cast(user_id as {str})) config_key,
 cast(value as {str}) config_value, {us} updated_us
from events
"""

TRAINING_LOGS = """
select o_orderkey id, concat('v1.', cast(o_custkey%10 as int), '.', cast(o_orderkey%100 as int)) model_version,
 cast(9000+(o_orderkey*7)%1000 as double)/10000.0 accuracy,
 cast(9000+(o_orderkey*13)%1000 as double)/10000.0 f1_score,
 {ordus} trained_us,
 case when o_orderpriority='1-URGENT' then null else o_orderpriority end notes
from orders
"""

#: Labelled flows with infinities and gaps. flow_no .. dst_no together name a row.
RAW_FLOWS = """
select l_orderkey flow_no, l_linenumber line_no, l_partkey src_no, l_suppkey dst_no,
 cast((l_orderkey%1000003*7919 + l_linenumber*104729 + l_partkey%1000003*31
   + l_suppkey%1000003*17 + cast(l_quantity as int)*13 + 42)%1000003 as bigint) shuffle_key,
 case cast(l_suppkey%3 as int) when 0 then 80 when 1 then 443 else 22 end dst_port,
 case when l_tax=0 then cast('Infinity' as double) else l_extendedprice/l_tax end flow_bytes_s,
 case when l_discount=0 then null else l_quantity/l_discount end flow_pkts_s,
 l_quantity fwd_pkts, l_extendedprice fwd_bytes,
 l_quantity*40+l_linenumber fwd_header_len,
 l_extendedprice/l_quantity avg_fwd_size,
 l_tax*1000000.0 flow_duration,
 case when l_returnflag='A' then 'DDoS' when l_returnflag='R' then 'PortScan'
   when l_linestatus='F' then 'DoS Hulk' else 'BENIGN' end label
from lineitem
"""
FLOW_KEYS = ["flow_no", "line_no", "src_no", "dst_no"]
FLOW_NUMERIC = ["dst_port", "flow_bytes_s", "flow_pkts_s", "fwd_pkts", "fwd_bytes",
                "fwd_header_len", "avg_fwd_size", "flow_duration"]

#: The names these columns have in flow files.
FLOW_NAMES = {
    "dst_port": " Destination Port", "flow_bytes_s": "Flow Bytes/s", "flow_pkts_s": " Flow Packets/s",
    "fwd_pkts": " Total Fwd Packets", "fwd_bytes": "Total Length of Fwd Packets",
    "fwd_header_len": " Fwd Header Length", "avg_fwd_size": " Avg Fwd Segment Size",
    "flow_duration": " Flow Duration", "label": " Label",
}

#: The same flows with labels that follow from the features, but for some rows.
LEARNABLE = f"""
select flow_no, line_no, src_no, dst_no, shuffle_key, dst_port, flow_bytes_s, flow_pkts_s, fwd_pkts,
 fwd_bytes, fwd_header_len, avg_fwd_size, flow_duration,
 case when shuffle_key%200=0 then label when fwd_bytes>60000 then 'DDoS' when fwd_pkts<8 then 'PortScan'
  when avg_fwd_size>2500 then 'DoS Hulk' else 'BENIGN' end label
from ({RAW_FLOWS}) r
"""

#: Truth and a prediction that is wrong for known rows.
PREDICTIONS = f"""
select flow_no, line_no, src_no, dst_no, label truth,
 case when shuffle_key%17=0 then 'BENIGN' when shuffle_key%23=0 then 'DDoS' else label end predicted
from ({RAW_FLOWS}) r
"""


def sql_text(view: str, dialect: str) -> str:
    """The view's SQL for ``spark`` or ``duckdb``."""
    for word, meaning in DIALECTS[dialect].items():
        view = view.replace("{" + word + "}", meaning)
    return view.strip()


def _run(spark: SparkSession, folder: str, name: str, view: str) -> DataFrame:
    source = table(spark, folder, name)
    return spark.sql(sql_text(view, "spark").replace(f"from {name}", "from {src}"), src=source)


def packets(spark, folder):
    return _run(spark, folder, "events", PACKETS)


def scored(spark, folder):
    return _run(spark, folder, "events", SCORED)


def alerts(spark, folder):
    return _run(spark, folder, "events", ALERTS)


def allow_list(spark, folder):
    return _run(spark, folder, "events", ALLOW_LIST)


def deny_list(spark, folder):
    return _run(spark, folder, "events", DENY_LIST)


def list_entries(spark, folder):
    return _run(spark, folder, "events", LIST_ENTRIES)


def config_log(spark, folder):
    return _run(spark, folder, "events", CONFIG_LOG)


def training_logs(spark, folder):
    return _run(spark, folder, "orders", TRAINING_LOGS)


def raw_flows(spark, folder):
    return _run(spark, folder, "lineitem", RAW_FLOWS)


def predictions(spark, folder):
    return _run(spark, folder, "lineitem", PREDICTIONS)


def learnable_flows(spark, folder):
    return _run(spark, folder, "lineitem", LEARNABLE)
