"""Queries over stored alerts, lists, settings and logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from netweave.functions.scalars import looks_like_ipv4, parse_iso
from netweave.operators import alerts, records
from netweave.plans.registry import query
from netweave.sources import views
from netweave.sources.tables import TABLES, table
from netweave.sources.views import (
    ALERTS, AS_OF, AS_OF_US, CONFIG_LOG, LIST_ENTRIES, SCORED, TRAINING_LOGS,
)

COLUMNS = ["id", "ts_us", "source_ip", "dest_ip", "attack_type", "confidence", "severity"]
PICK = ", ".join(COLUMNS)

#: Alerts of the second week of the month, both ends included.
WEEK = (datetime(2024, 1, 8), datetime(2024, 1, 15))
WEEK_SQL = "ts >= timestamp '2024-01-08 00:00:00' and ts <= timestamp '2024-01-15 00:00:00'"
SEARCH_SQL = f"attack_type = 'DDoS' and severity = 'critical' and {WEEK_SQL}"
ONE_SOURCE = "10.0.0.7"

CLASS_COUNTS = """count(*) filter (attack_type = 'DoS Hulk') dos_hulk,
 count(*) filter (attack_type = 'PortScan') portscan, count(*) filter (attack_type = 'DDoS') ddos"""


def found_alerts(spark, folder):
    return alerts.search(views.alerts(spark, folder), attack_type="DDoS", severity="critical",
                         start=WEEK[0], end=WEEK[1])


@query("alert_search", f"select {PICK} from ({ALERTS}) a where {SEARCH_SQL}")
def alert_search(spark, folder):
    return found_alerts(spark, folder).select(*COLUMNS)


@query("alert_search_source", f"select {PICK} from ({ALERTS}) a where source_ip = '{ONE_SOURCE}' and {WEEK_SQL}")
def alert_search_source(spark, folder):
    found = alerts.search(views.alerts(spark, folder), source_ip=ONE_SOURCE, start=WEEK[0], end=WEEK[1])
    return found.select(*COLUMNS)


@query("alert_page", f"""
select {PICK} from ({ALERTS}) a where severity = 'critical' order by ts_us desc, id desc limit 50 offset 100""")
def alert_page(spark, folder):
    found = alerts.search(views.alerts(spark, folder), severity="critical")
    return alerts.page(found, number=3, limit=50).select(*COLUMNS)


@query("page_meta", f"""
select count(*) total, cast(3 as bigint) page, cast(50 as bigint) page_limit,
 greatest(cast(ceil(count(*) / 50.0) as bigint), cast(1 as bigint)) pages,
 3 < greatest(cast(ceil(count(*) / 50.0) as bigint), 1) has_next, true has_prev
from ({ALERTS}) a where {SEARCH_SQL}""")
def page_meta(spark, folder):
    return alerts.page_meta(found_alerts(spark, folder), number=3, limit=50)


@query("recent_alerts", f"select {PICK} from ({ALERTS}) a order by ts_us desc, id desc limit 10")
def recent_alerts(spark, folder):
    return alerts.recent(views.alerts(spark, folder)).select(*COLUMNS)


@query("alerts_by_ip", f"""
select {PICK} from ({ALERTS}) a where source_ip = '{ONE_SOURCE}' order by ts_us desc, id desc limit 100""")
def alerts_by_ip(spark, folder):
    return alerts.from_source(views.alerts(spark, folder), ONE_SOURCE).select(*COLUMNS)


@query("alert_by_id", f"select {PICK} from ({ALERTS}) a where id = (select min(id) from ({ALERTS}) b)")
def alert_by_id(spark, folder):
    stored = views.alerts(spark, folder)
    first = stored.agg(F.min("id")).first()[0]
    return alerts.by_id(stored, first).select(*COLUMNS)


@query("alert_count", f"select count(*) alerts from ({ALERTS}) a where {SEARCH_SQL}")
def alert_count(spark, folder):
    return alerts.count(found_alerts(spark, folder))


@query("alert_stats_24h", f"""
select count(*) total_alerts, count(*) filter (severity = 'critical') critical_alerts,
 count(*) - count(*) filter (severity = 'critical') low_alerts, {CLASS_COUNTS},
 cast(24 as bigint) time_period_hours
from ({ALERTS}) a where ts_us >= {AS_OF_US} - 24 * 3600000000""")
def alert_stats_24h(spark, folder):
    return alerts.last_hours(views.alerts(spark, folder), AS_OF)


@query("dashboard_overview", f"""
select count(*) total_alerts, count(*) filter (severity = 'critical') critical_alerts,
 count(*) filter (severity = 'low') low_alerts, {CLASS_COUNTS} from ({ALERTS}) a""")
def dashboard_overview(spark, folder):
    return alerts.overview(views.alerts(spark, folder))


@query("top_targets", f"""
select dest_ip, count(*) attack_count from ({ALERTS}) a group by dest_ip
order by attack_count desc, dest_ip limit 10""")
def top_targets(spark, folder):
    return alerts.top_targets(views.alerts(spark, folder))


def _timeline_sql(hours: int, minutes: int) -> str:
    start, width, buckets = AS_OF_US - hours * 3_600_000_000, minutes * 60_000_000, hours * 60 // minutes + 1
    begin = f"({start} + bucket * {width})"
    return f"""
with counted as (
 select cast(floor((ts_us - {start}) / {width}.0) as bigint) bucket, count(*) total, {CLASS_COUNTS},
  count(*) filter (severity = 'critical') critical, count(*) filter (severity = 'low') low
 from ({ALERTS}) a where ts_us >= {start} group by 1)
select bucket, cast({begin} as bigint) start_us,
 strftime(make_timestamp(cast({begin} as bigint)), '%Y-%m-%dT%H:%M:%S') start_time,
 coalesce(total, 0) total, coalesce(dos_hulk, 0) dos_hulk, coalesce(portscan, 0) portscan,
 coalesce(ddos, 0) ddos, coalesce(critical, 0) critical, coalesce(low, 0) low
from (select unnest(range({buckets})) bucket) g left join counted using (bucket)"""


def _register_timeline(period: str, hours: int, minutes: int) -> None:
    @query(f"timeline_{period}", _timeline_sql(hours, minutes))
    def timeline(spark, folder):
        return alerts.timeline(views.alerts(spark, folder), AS_OF, period)


for _period, (_hours, _minutes) in alerts.TIMELINE_PERIODS.items():
    _register_timeline(_period, _hours, _minutes)


@query("timeline_summary", f"""
select 'week' period, cast(1440 as bigint) interval_minutes, count(*) total_alerts,
 count(*) filter (severity = 'critical') critical_alerts,
 count(*) - count(*) filter (severity = 'critical') low_alerts
from ({ALERTS}) a where ts_us >= {AS_OF_US} - 168 * 3600000000""")
def timeline_summary(spark, folder):
    return alerts.timeline_summary(views.alerts(spark, folder), AS_OF, "week")


@query("alert_delete", f"select {PICK} from ({ALERTS}) a where confidence >= 0.91")
def alert_delete(spark, folder):
    """Alerts without those on a list of ids: the ones classified least surely."""
    stored = views.alerts(spark, folder)
    doomed = stored.where(F.col("confidence") < 0.91).select("id")
    return records.delete_rows(stored, doomed).select(*COLUMNS)


#: Sign-ups make up the list so far; clicks and errors ask to be added.
OLD_ENTRIES = f"""
(select ip_address, arg_min(id, added_us) id, arg_min(description, added_us) description, min(added_us) added_us
 from ({LIST_ENTRIES}) e where description = 'signup' group by ip_address)"""


def old_entries(spark, folder):
    entries = views.list_entries(spark, folder).where(F.col("description") == "signup")
    return records.first_per_key(entries, "ip_address", ["added_us", "id"])


@query("list_insert", f"""
with old as {OLD_ENTRIES}
select id, ip_address, description, added_us from old
union all
select arg_min(id, added_us) id, ip_address, arg_min(description, added_us) description, min(added_us) added_us
from ({LIST_ENTRIES}) e where description in ('click', 'error')
 and ip_address not in (select ip_address from old) group by ip_address""")
def list_insert(spark, folder):
    added = views.list_entries(spark, folder).where(F.col("description").isin("click", "error"))
    return records.list_insert(old_entries(spark, folder), added)


@query("list_remove", f"""
select id, ip_address, description, added_us from {OLD_ENTRIES} o
where ip_address not in (select ip_address from ({views.DENY_LIST}) d)""")
def list_remove(spark, folder):
    return records.list_remove(old_entries(spark, folder), views.deny_list(spark, folder))


@query("list_newest", f"""
select id, ip_address, description, added_us from {OLD_ENTRIES} o order by added_us desc, id desc""")
def list_newest(spark, folder):
    return records.newest_entries(old_entries(spark, folder))


SETTINGS = f"""
(select config_key, arg_max(id, updated_us) id, arg_max(config_value, updated_us) config_value,
 max(updated_us) updated_us from ({CONFIG_LOG}) c group by config_key)"""


@query("config_upsert", f"select id, config_key, config_value, updated_us from {SETTINGS} s")
def config_upsert(spark, folder):
    return records.settings(views.config_log(spark, folder))


@query("config_get", f"""
select 'limit_7' config_key, (select config_value from {SETTINGS} s where config_key = 'limit_7') config_value
union all select 'alert_threshold', '0.95'""")
def config_get(spark, folder):
    log = views.config_log(spark, folder)
    return records.setting(log, "limit_7").unionByName(records.setting(log, "alert_threshold", "0.95"))


@query("config_delete", f"""
select id, config_key, config_value, updated_us from {SETTINGS} s
where config_key not in (select config_key from ({CONFIG_LOG}) c where config_value < '10')
order by config_key""")
def config_delete(spark, folder):
    """Settings in order of their keys, without those that ever held a small value."""
    log = views.config_log(spark, folder)
    small = log.where(F.col("config_value") < "10").select("config_key")
    return records.settings_without(log, small).orderBy("config_key")


@query("latest_training", f"select * from ({TRAINING_LOGS}) t order by trained_us desc, id desc limit 1")
def latest_training(spark, folder):
    return records.latest_training(views.training_logs(spark, folder))


@query("training_history", f"select * from ({TRAINING_LOGS}) t order by trained_us desc, id desc limit 50")
def training_history(spark, folder):
    return records.training_history(views.training_logs(spark, folder))


@query("table_counts", "\nunion all\n".join(f"select '{t}' table_name, count(*) row_count from {t}" for t in TABLES))
def table_counts(spark, folder):
    return records.table_counts({t: table(spark, folder, t) for t in TABLES})


ADDRESSES = "concat('10.0.', cast(cast(id%300 as int) as {str}), '.', cast(cast(id%400 as int) as {str}))"


@query("valid_ip", f"""
select id, address, regexp_full_match(address, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}')
 and list_max(list_transform(string_split(address, '.'), lambda p: cast(p as int))) <= 255 is_valid
from (select id, {ADDRESSES} address from ({SCORED}) s) t""")
def valid_ip(spark, folder):
    found = views.scored(spark, folder).select(
        "id", F.concat(F.lit("10.0."), (F.col("id") % 300).cast("string"), F.lit("."),
                       (F.col("id") % 400).cast("string")).alias("address"))
    return found.withColumn("is_valid", looks_like_ipv4(F.col("address")))


@query("iso_parse", f"""
select id, given, case when given like '%x' then null else ts_us end parsed_us
from (select id, ts_us, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f')
  || case when attack_type = 'DDoS' then 'x' when attack_type = 'PortScan' then 'Z' else '' end given
 from ({SCORED}) s) t""")
def iso_parse(spark, folder):
    """Event times as ISO text, some with Z and some malformed, read back."""
    ending = F.when(F.col("attack_type") == "DDoS", "x").when(F.col("attack_type") == "PortScan", "Z").otherwise("")
    text = F.concat(F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), ending)
    found = views.scored(spark, folder).select("id", text.alias("given"))
    return found.withColumn("parsed_us", F.unix_micros(parse_iso(F.col("given"))))


@query("auto_block", f"""
select source_ip, count(*) critical_alerts, max(ts_us) + 24 * 3600000000 blocked_until_us
from ({ALERTS}) a where severity = 'critical' group by source_ip having count(*) >= 10""")
def auto_block(spark, folder):
    return alerts.auto_block(views.alerts(spark, folder))


@query("retention", f"select {PICK} from ({ALERTS}) a where ts >= timestamp '2024-01-24 00:00:00'")
def retention(spark, folder):
    return alerts.retained(views.alerts(spark, folder), AS_OF, days=7).select(*COLUMNS)


HALF_US = AS_OF_US - 15 * 86_400_000_000
FRESH_COLUMNS = [c for c in COLUMNS if c != "id"]


@query("alert_append", f"""
with stored as (select {PICK} from ({ALERTS}) a where ts_us < {HALF_US}),
fresh as (select {PICK} from ({ALERTS}) b where ts_us >= {HALF_US})
select * from stored union all
select (select coalesce(max(id), 0) from stored) + row_number() over (order by {', '.join(FRESH_COLUMNS)}, id),
 {', '.join(FRESH_COLUMNS)} from fresh""")
def alert_append(spark, folder):
    """The alerts of the last days appended to the earlier ones under new ids."""
    found = views.alerts(spark, folder).select(*COLUMNS)
    stored, fresh = found.where(F.col("ts_us") < HALF_US), found.where(F.col("ts_us") >= HALF_US)
    return records.append(stored, fresh, [*FRESH_COLUMNS, "id"])


@query("training_log_append", f"""
with stored as (select id, model_version, accuracy, f1_score, trained_us, notes from ({TRAINING_LOGS}) l where id % 2 = 0),
fresh as (select id, model_version, accuracy, f1_score, trained_us, notes from ({TRAINING_LOGS}) m where id % 2 = 1)
select * from stored union all
select (select coalesce(max(id), 0) from stored) + row_number() over (order by trained_us, id),
 model_version, accuracy, f1_score, trained_us, notes from fresh""")
def training_log_append(spark, folder):
    """Half of the training log appended to the other half in order of training."""
    logs = views.training_logs(spark, folder)
    return records.append(logs.where("id % 2 = 0"), logs.where("id % 2 = 1"), ["trained_us", "id"])
