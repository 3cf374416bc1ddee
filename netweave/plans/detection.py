"""Queries over scored flows: the way to alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweave.constants import ALERT_THRESHOLD, CLASSES, DEDUP_WINDOW_US, MODEL_FEATURES, QUALITY_GATES
from netweave.operators import alerts, cascade, dedup, membership, models, records
from netweave.plans.registry import query
from netweave.session import work_path
from netweave.sources import views
from netweave.sources.views import ALERTS, ALLOW_LIST, AS_OF_US, DENY_LIST, SCORED, TRAINING_LOGS, WIDE_GAP_US

WINDOW = WIDE_GAP_US
#: The data covers a month; this many step levels hold it for the window above.
LEVELS = dedup.levels_for(31 * 86_400_000_000, WINDOW)
#: Scores end in .900 to .999, and half of the attacks pass this limit.
LIMIT = 0.95

SURE = f"(select * from ({SCORED}) s where attack_type <> 'BENIGN' and confidence >= {LIMIT})"
PASSED = f"(select * from {SURE} c where source_ip not in (select ip_address from ({ALLOW_LIST}) a))"

#: The walk through a key's rows in order, one kept row after the other.
KEPT = f"""
recursive passed as (select id, ts_us, source_ip, dest_ip, attack_type, confidence from {PASSED} p),
numbered as (
 select *, row_number() over (partition by source_ip, attack_type order by ts_us, id) rn from passed),
walk as (
 select id, ts_us, source_ip, dest_ip, attack_type, confidence, rn, ts_us last_kept, true kept
 from numbered where rn = 1
 union all
 select n.id, n.ts_us, n.source_ip, n.dest_ip, n.attack_type, n.confidence, n.rn,
  case when n.ts_us - w.last_kept >= {WINDOW} then n.ts_us else w.last_kept end,
  n.ts_us - w.last_kept >= {WINDOW}
 from walk w join numbered n
  on n.source_ip = w.source_ip and n.attack_type = w.attack_type and n.rn = w.rn + 1),
kept as (select * from walk where kept),
cache as (select source_ip, attack_type, max(ts_us) last_kept from kept group by 1, 2)
"""

COLUMNS = ["id", "ts_us", "source_ip", "dest_ip", "attack_type", "confidence"]


def passed_rows(spark, folder):
    return cascade.candidates(views.scored(spark, folder), views.allow_list(spark, folder), LIMIT)


def kept_keys(spark, folder):
    return dedup.kept_moments(
        passed_rows(spark, folder), cascade.ALERT_KEY, "ts_us", "id", WINDOW, LEVELS
    )


@query("cascade", f"select {', '.join(COLUMNS)} from {PASSED} p")
def cascade_rows(spark, folder):
    return passed_rows(spark, folder).select(*COLUMNS)


@query("severity", f"""
select id, confidence, case when confidence >= 0.95 then 'critical' else 'low' end severity from ({SCORED}) s""")
def severity(spark, folder):
    return cascade.with_severity(views.scored(spark, folder)).select("id", "confidence", "severity")


@query("allowlist_anti", f"""
select id, source_ip from ({ALERTS}) t where source_ip not in (select ip_address from ({ALLOW_LIST}) a)""")
def allowlist_anti(spark, folder):
    found = membership.without_members(
        views.alerts(spark, folder), "source_ip", views.allow_list(spark, folder), "ip_address")
    return found.select("id", "source_ip")


@query("allowlist_semi", f"""
select id, source_ip from ({ALERTS}) t where source_ip in (select ip_address from ({ALLOW_LIST}) a)""")
def allowlist_semi(spark, folder):
    found = membership.only_members(
        views.alerts(spark, folder), "source_ip", views.allow_list(spark, folder), "ip_address")
    return found.select("id", "source_ip")


@query("denylist_tag", f"""
select id, source_ip, source_ip in (select ip_address from ({DENY_LIST}) d) deny_listed from ({ALERTS}) t""")
def denylist_tag(spark, folder):
    found = membership.tag_members(
        views.alerts(spark, folder), "source_ip", views.deny_list(spark, folder), "ip_address", "deny_listed")
    return found.select("id", "source_ip", "deny_listed")


@query("alert_dedup", f"""
with {KEPT}
select id, ts_us, source_ip, dest_ip, attack_type, confidence,
 case when confidence >= 0.95 then 'critical' else 'low' end severity from kept""")
def alert_dedup(spark, folder):
    found = cascade.new_alerts(
        views.scored(spark, folder), views.allow_list(spark, folder), LIMIT, WINDOW, LEVELS)
    return found.select(*COLUMNS, "severity")


@query("dedup_state", f"with {KEPT} select * from cache")
def dedup_state(spark, folder):
    return dedup.cache_content(kept_keys(spark, folder), cascade.ALERT_KEY, "ts_us")


#: The cleanup runs two days before the end of the month.
CLEANED_AT_US = AS_OF_US - 48 * 3_600_000_000


@query("dedup_expired", f"with {KEPT} select * from cache where last_kept < {CLEANED_AT_US - WINDOW}")
def dedup_expired(spark, folder):
    cache = dedup.cache_content(kept_keys(spark, folder), cascade.ALERT_KEY, "ts_us")
    return dedup.expired_entries(cache, CLEANED_AT_US, WINDOW)


@query("dedup_stats", f"""
with {KEPT}
select (select count(*) from passed) total_checks,
 (select count(*) from passed) - (select count(*) from kept) duplicates_blocked,
 (select count(*) from kept) unique_alerts, (select count(*) from cache) cache_size,
 round(cast((select count(*) from passed) - (select count(*) from kept) as double)
  / (select count(*) from passed) * 100, 2) block_rate""")
def dedup_stats(spark, folder):
    return dedup.dedup_stats(passed_rows(spark, folder), kept_keys(spark, folder), cascade.ALERT_KEY)


@query("cascade_funnel", f"""
with {KEPT}
select count(*) total_predictions,
 count(*) filter (attack_type = 'BENIGN') benign_filtered,
 count(*) filter (attack_type <> 'BENIGN' and confidence < {LIMIT}) low_confidence_skipped,
 (select count(*) from {SURE} c) - (select count(*) from passed) whitelist_skipped,
 (select count(*) from passed) - (select count(*) from kept) duplicates_blocked,
 (select count(*) from kept) alerts_created,
 (select count(*) from kept where attack_type = 'DoS Hulk') dos_hulk,
 (select count(*) from kept where attack_type = 'PortScan') portscan,
 (select count(*) from kept where attack_type = 'DDoS') ddos
from ({SCORED}) s""")
def cascade_funnel(spark, folder):
    return cascade.funnel(
        views.scored(spark, folder), views.allow_list(spark, folder), LIMIT, WINDOW, LEVELS)


#: The newest training run that reaches the gates.
IN_USE = f"""
select * from ({TRAINING_LOGS}) t where accuracy >= {QUALITY_GATES['min_accuracy']} and f1_score >= {QUALITY_GATES['min_f1_score']}
order by trained_us desc, id desc limit 1"""


def model_registry(spark, folder):
    """All training runs registered, the newest promoted, and then the newest that reaches the gates."""
    path = work_path(spark, "models")
    models.register(models.versions_of(views.training_logs(spark, folder)), path)
    known = models.versions(spark, path)
    for some in (known, models.passing(known)):
        models.promote(spark, path, records.latest_training(some))
    return models.in_use(spark, path)


@query("model_info", f"""
select model_version "version", 'boosted' algorithm, cast({len(MODEL_FEATURES)} as int) features_count, '{','.join(CLASSES)}' classes,
 cast({len(CLASSES)} as int) classes_count, accuracy, f1_score, trained_us, {ALERT_THRESHOLD}::double alert_threshold,
 cast({DEDUP_WINDOW_US // 1_000_000} as bigint) deduplication_window from ({IN_USE}) c""")
def model_info(spark, folder):
    """The model in use out of a registry of all training runs."""
    return models.model_info(model_registry(spark, folder))


@query("model_status", f"""
with {KEPT}
select (select count(*) from ({IN_USE}) c) > 0 model_loaded, (select max(model_version) from ({IN_USE}) c) "version",
 count(*) total_predictions,
 count(*) filter (attack_type = 'BENIGN') benign_filtered,
 count(*) filter (attack_type <> 'BENIGN' and confidence < {LIMIT}) low_confidence_skipped,
 (select count(*) from {SURE} c) - (select count(*) from passed) whitelist_skipped,
 (select count(*) from passed) - (select count(*) from kept) duplicates_blocked,
 (select count(*) from kept) alerts_created,
 (select count(*) from kept where attack_type = 'DoS Hulk') dos_hulk,
 (select count(*) from kept where attack_type = 'PortScan') portscan,
 (select count(*) from kept where attack_type = 'DDoS') ddos
from ({SCORED}) s""")
def model_status(spark, folder):
    """Whether a model is in use, and the counters of its detection."""
    return models.model_status(model_registry(spark, folder), cascade_funnel(spark, folder))


@query("alert_json", f"""
select id, concat('{{"source_ip":"', source_ip, '","dest_ip":"', dest_ip, '","attack_type":"', attack_type,
 '","confidence":', cast(confidence as varchar), ',"severity":"', severity, '","timestamp":"',
 case when ts_us % 1000000 = 0 then strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S')
  else strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') end,
 '","id":', cast(id as varchar), '}}') message
from ({ALERTS}) a""")
def alert_json(spark, folder):
    return alerts.as_json(views.alerts(spark, folder))
