"""Queries over labelled flow tables: reading, profiling, cleaning, preparing."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweave.constants import ATTACK_CLASSES, CLASS_WEIGHTS, LITERATURE_FEATURES, NAME_GROUPS
from netweave.functions.scalars import col_of, duration_text
from netweave.operators import balance, clean, prep, profile
from netweave.plans.registry import query
from netweave.session import prepared, remembered, work_path
from netweave.sources import csv_flows, views
from netweave.sources.views import FLOW_KEYS, FLOW_NAMES, FLOW_NUMERIC, RAW_FLOWS

KEYS = ", ".join(FLOW_KEYS)
DOUBLES = [c for c in FLOW_NUMERIC if c != "dst_port"]
ROW_ORDER = ", ".join(["shuffle_key", *FLOW_KEYS])
ATTACKS_SQL = "('DoS Hulk', 'PortScan', 'DDoS')"

FINITE = f"""(
select {KEYS}, shuffle_key, dst_port, label,
 {', '.join(f"case when isinf({c}) then (select coalesce(max({c}) filter (isfinite({c})), 0) from ({RAW_FLOWS}) m) else {c} end {c}" for c in DOUBLES)}
from ({RAW_FLOWS}) r)"""
CLEAN = f"""(
select {KEYS}, shuffle_key, dst_port, label,
 {', '.join(f"coalesce({c}, (select median({c}) from {FINITE} m)) {c}" for c in DOUBLES)}
from {FINITE} f)"""
SPLIT = f"""(
select *, case when rn <= ceil(n * 0.2::double) then 'test'
  when rn <= ceil(n * 0.2::double) + ceil((n - ceil(n * 0.2::double)) * 0.125::double) then 'validation'
  else 'train' end part
from (select *, row_number() over (partition by label order by {ROW_ORDER}) rn,
 count(*) over (partition by label) n from %s c) x)"""
LABEL_ID = "case label when 'BENIGN' then 0 when 'DoS Hulk' then 1 when 'PortScan' then 2 else 3 end"


def cleaned(spark, folder):
    """The flows as cleaned. What fills the gaps is learned once; the rows are read and never written."""
    raw = views.raw_flows(spark, folder)
    return clean.clean(raw, known=remembered(spark, folder, "lineitem", "clean-flows", lambda: clean.repairs(raw)))


def split(df, ends=None):
    return prep.stratified_split(df, "label", "shuffle_key", FLOW_KEYS, ends=ends)


def split_ends(df):
    return prep.split_thresholds(df, "label", "shuffle_key", FLOW_KEYS)


def split_flows(spark, folder):
    """The cleaned flows with their part. Only where the parts end, a row per class, is written."""
    # Cleaning changes no column that the split reads.
    ends = prepared(spark, folder, "lineitem", "split-ends", lambda: split_ends(views.raw_flows(spark, folder)))
    return split(cleaned(spark, folder), ends)


@query("flow_csv_union", f"""
select {KEYS}, {', '.join(c for c in FLOW_NUMERIC if c != 'flow_duration')},
 case when label in {ATTACKS_SQL} then flow_duration end flow_duration, label from ({RAW_FLOWS}) r""")
def flow_csv_union(spark, folder):
    """The labelled flows written as one CSV per attack or not, and read back as one table."""
    flows = csv_flows.renamed(views.raw_flows(spark, folder).drop("shuffle_key"), FLOW_NAMES)
    place = work_path(spark, "flow-csv")
    attack = F.col("` Label`").isin(ATTACK_CLASSES)
    csv_flows.write_csv(flows.where(attack), f"{place}/attacks.csv")
    # The other file has its columns in another order and lacks one.
    backward = flows.select(*[col_of(c) for c in reversed(flows.columns) if c != FLOW_NAMES["flow_duration"]])
    csv_flows.write_csv(backward.where(~attack), f"{place}/benign.csv")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flows.schema)
    back = csv_flows.read_flows(spark, place, schema)
    return csv_flows.renamed(back, {v: k for k, v in FLOW_NAMES.items()})


@query("head_sample", f"""
select {KEYS} from ({RAW_FLOWS}) r order by {KEYS}
limit (select cast(floor(count(*) * 0.1::double) as bigint) from ({RAW_FLOWS}) n)""")
def head_sample(spark, folder):
    return prep.head_sample(views.raw_flows(spark, folder), FLOW_KEYS, 0.1).select(*FLOW_KEYS)


@query("class_coverage", f"""
with ordered as (select label, row_number() over (order by {KEYS}) rn, count(*) over () n from ({RAW_FLOWS}) r),
small as (select label from ordered where rn <= floor(n * 0.1::double)),
wide as (select label from ordered where rn <= floor(n * 0.2::double)),
sampled as (
 select 0.1::double share, count(*) row_count, count(distinct label) class_count from small
 union all select 0.2::double, count(*), count(distinct label) from wide)
select * from sampled where (share = 0.1::double) = ((select class_count from sampled where share = 0.1::double) >= 4)""")
def class_coverage(spark, folder):
    return prep.class_coverage(views.raw_flows(spark, folder), FLOW_KEYS)


@query("class_distribution", f"""
select label, count(*) row_count, round(count(*) / sum(count(*)) over () * 100, 4) pct
from ({RAW_FLOWS}) r group by label""")
def class_distribution(spark, folder):
    return profile.class_distribution(views.raw_flows(spark, folder))


@query("missing_profile", f"""
select 'flow_pkts_s' column_name, count(*) filter (flow_pkts_s is null) missing_count,
 round(count(*) filter (flow_pkts_s is null) / count(*) * 100, 4) missing_pct from ({RAW_FLOWS}) r""")
def missing_profile(spark, folder):
    return profile.missing_profile(views.raw_flows(spark, folder))


@query("infinity_profile", f"""
select 'flow_bytes_s' column_name, count(*) filter (isinf(flow_bytes_s)) infinite_count from ({RAW_FLOWS}) r""")
def infinity_profile(spark, folder):
    return profile.infinity_profile(views.raw_flows(spark, folder))


@query("numeric_ranges", "\nunion all\n".join(
    f"select '{c}' column_name, cast(min({c}) as double) min_value, cast(max({c}) as double) max_value from {CLEAN} c"
    for c in FLOW_NUMERIC))
def numeric_ranges(spark, folder):
    return profile.numeric_ranges(cleaned(spark, folder).select(*FLOW_NUMERIC, "label"))


@query("quality_check", f"""
select count(*) row_count, cast({len(FLOW_NUMERIC) + 1} as bigint) column_count,
 count(*) filter (flow_pkts_s is null) missing_total, count(*) filter (isinf(flow_bytes_s)) infinite_total,
 count(distinct label) class_count from ({RAW_FLOWS}) r""")
def quality_check(spark, folder):
    return profile.quality_check(views.raw_flows(spark, folder).select(*FLOW_NUMERIC, "label"))


@query("feature_categories", "\nunion all\n".join(
    "select '{0}' column_name, {1}, count({2}) value_count from ({3}) r".format(
        name, ", ".join(f"{str(any(w in name for w in words)).lower()} is_{group}" for group, words in NAME_GROUPS.items()),
        short, RAW_FLOWS)
    for short, name in FLOW_NAMES.items()))
def feature_categories(spark, folder):
    flows = views.raw_flows(spark, folder).select(*FLOW_NAMES)
    return profile.feature_categories(csv_flows.renamed(flows, FLOW_NAMES))


@query("literature_match", f"""
with names as (select unnest({list(FLOW_NAMES.values())!r}) column_name, generate_subscripts({list(FLOW_NAMES.values())!r}, 1) i),
wanted as (select unnest({LITERATURE_FEATURES!r}) feature),
matched as (select feature, arg_min(column_name, i) column_name from wanted, names
 where contains(lower(column_name), lower(feature)) group by feature)
select w.feature, m.column_name, r.row_count from wanted w left join matched m using (feature), (select count(*) row_count from ({RAW_FLOWS}) x) r""")
def literature_match(spark, folder):
    """For every feature of the literature the column of the flow table that bears its name."""
    flows = csv_flows.renamed(views.raw_flows(spark, folder).select(*FLOW_NAMES), FLOW_NAMES)
    found = list(profile.literature_matches(flows.columns).items())
    matches = spark.createDataFrame(found, "feature string, column_name string")
    rows = flows.agg(F.count(F.lit(1)).alias("row_count"))
    return matches.join(F.broadcast(rows), F.lit(True))


@query("filter_classes", f"select {KEYS}, label from ({RAW_FLOWS}) r where label in {ATTACKS_SQL}")
def filter_classes(spark, folder):
    found = clean.keep_classes(views.raw_flows(spark, folder), ATTACK_CLASSES)
    return found.select(*FLOW_KEYS, "label")


@query("select_features", f"""
select flow_bytes_s "Flow Bytes/s", fwd_pkts " Total Fwd Packets", flow_duration " Flow Duration", label " Label"
from ({RAW_FLOWS}) r""")
def select_features(spark, folder):
    """Wanted names differ in spaces, and one is not in the table at all."""
    flows = csv_flows.renamed(views.raw_flows(spark, folder), FLOW_NAMES)
    wanted = ["Flow Bytes/s", "Total Fwd Packets", "Flow Duration ", " Label", " SYN Flag Count"]
    return clean.select_features(flows, wanted)


@query("unexpected_labels", f"""
select label, count(*) row_count from ({RAW_FLOWS}) r where label not in {ATTACKS_SQL} group by label""")
def unexpected_labels(spark, folder):
    return clean.unexpected_labels(views.raw_flows(spark, folder), ATTACK_CLASSES)


@query("clean_infinity", f"select {KEYS}, flow_bytes_s, flow_pkts_s from {FINITE} f")
def clean_infinity(spark, folder):
    flows = views.raw_flows(spark, folder)
    found = clean.replace_infinity(flows, clean.finite_maxima(flows))
    return found.select(*FLOW_KEYS, "flow_bytes_s", "flow_pkts_s")


@query("impute_median", f"select {KEYS}, flow_bytes_s, flow_pkts_s, fwd_pkts, fwd_bytes from {CLEAN} c")
def impute_median(spark, folder):
    return cleaned(spark, folder).select(*FLOW_KEYS, "flow_bytes_s", "flow_pkts_s", "fwd_pkts", "fwd_bytes")


@query("validate_clean", f"""
select {KEYS}, label, coalesce(case when isinf(flow_bytes_s) then null else flow_bytes_s end,
  (select median(flow_bytes_s) from ({RAW_FLOWS}) m where not isinf(flow_bytes_s))) flow_bytes_s,
 coalesce(flow_pkts_s, (select median(flow_pkts_s) from ({RAW_FLOWS}) m)) flow_pkts_s
from ({RAW_FLOWS}) r where label in {ATTACKS_SQL}""")
def validate_clean(spark, folder):
    found = clean.validate(views.raw_flows(spark, folder), classes=ATTACK_CLASSES)
    return found.select(*FLOW_KEYS, "label", "flow_bytes_s", "flow_pkts_s")


@query("label_encode", f"select {KEYS}, label, {LABEL_ID} label_id from ({RAW_FLOWS}) r")
def label_encode(spark, folder):
    return prep.encode_labels(views.raw_flows(spark, folder)).select(*FLOW_KEYS, "label", "label_id")


@query("label_decode", f"select {KEYS}, label from ({RAW_FLOWS}) r")
def label_decode(spark, folder):
    coded = prep.encode_labels(views.raw_flows(spark, folder)).drop("label")
    return prep.decode_labels(coded).select(*FLOW_KEYS, "label")


@query("label_remap", f"""
select {KEYS}, label_id, cast(dense_rank() over (order by label_id) - 1 as int) remapped
from (select *, {LABEL_ID} label_id from ({RAW_FLOWS}) r) x where label_id <> 1""")
def label_remap(spark, folder):
    coded = prep.encode_labels(views.raw_flows(spark, folder)).where(F.col("label_id") != 1)
    return prep.remap_labels(coded).select(*FLOW_KEYS, "label_id", "remapped")


@query("stratified_split", f"select {KEYS}, label, part from {SPLIT % f'({RAW_FLOWS})'} s")
def stratified_split(spark, folder):
    return split(views.raw_flows(spark, folder)).select(*FLOW_KEYS, "label", "part")


@query("standard_scale", f"""
with parts as (select * from {SPLIT % CLEAN} s),
fit as (select {', '.join(f'avg({c}) m_{c}, stddev_pop({c}) s_{c}' for c in FLOW_NUMERIC)} from parts where part = 'train')
select {KEYS}, part, {', '.join(f'round(({c} - m_{c}) / (case when s_{c} = 0 then 1 else s_{c} end), 4) {c}' for c in FLOW_NUMERIC)}
from parts, fit""")
def standard_scale(spark, folder):
    parts = split_flows(spark, folder)
    scaler = prep.fit_scaler(parts.where(F.col("part") == "train"), FLOW_NUMERIC)
    found = prep.scale(parts, scaler)
    return found.select(*FLOW_KEYS, "part", *[F.round(c, 4).alias(c) for c in FLOW_NUMERIC])


@query("class_weights", f"""
select label_id, count(*) row_count,
 case label_id when 0 then 1.0::double when 1 then 9.84::double when 2 then 14.31::double else 17.74::double end weight,
 round(max(count(*)) over () / count(*), 4) balanced_weight
from (select {LABEL_ID} label_id from ({RAW_FLOWS}) r) x group by label_id""")
def class_weights(spark, folder):
    return prep.class_weights(prep.encode_labels(views.raw_flows(spark, folder)))


@query("row_weights", f"""
select {KEYS}, case label when 'BENIGN' then 1.0::double when 'DoS Hulk' then 9.84::double
 when 'PortScan' then 14.31::double else 17.74::double end weight from ({RAW_FLOWS}) r""")
def row_weights(spark, folder):
    return prep.with_weight(prep.encode_labels(views.raw_flows(spark, folder)), CLASS_WEIGHTS).select(*FLOW_KEYS, "weight")


@query("duration_text", f"""
select {KEYS}, case when s >= 3600 then concat(s // 3600, 'h ', s % 3600 // 60, 'm ', s % 60, 's')
 when s >= 60 then concat(s // 60, 'm ', s % 60, 's') else concat(s, 's') end duration
from (select *, cast(floor(fwd_bytes / 10) as bigint) s from ({RAW_FLOWS}) r) x""")
def duration_texts(spark, folder):
    flows = views.raw_flows(spark, folder)
    return flows.select(*FLOW_KEYS, duration_text(F.col("fwd_bytes") / 10).alias("duration"))


@query("smote")
def smote(spark, folder):
    """Rows and means per class of the training part before and after balancing."""
    train = split_flows(spark, folder).where(F.col("part") == "train")
    filled = balance.smote(prep.encode_labels(train), FLOW_NUMERIC, FLOW_KEYS)
    return filled.groupBy("label_id").agg(
        F.count_if(~F.col("is_synthetic")).alias("given_rows"), F.count(F.lit(1)).alias("all_rows"),
        *[F.round(F.avg(col_of(c)), 6).alias(f"mean_{c}") for c in FLOW_NUMERIC])


@query("smote_counts", f"""
select {LABEL_ID} label_id, n given_rows, max(n) over () all_rows
from (select label, count(*) n from {SPLIT % CLEAN} s where part = 'train' group by label) x""")
def smote_counts(spark, folder):
    """Rows per class of the training part before and after balancing."""
    train = split_flows(spark, folder).where(F.col("part") == "train")
    filled = balance.smote(prep.encode_labels(train), FLOW_NUMERIC, FLOW_KEYS)
    return filled.groupBy("label_id").agg(
        F.count_if(~F.col("is_synthetic")).alias("given_rows"), F.count(F.lit(1)).alias("all_rows"))
