import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.operators import flows
from netweave.operators.training import FixedRule
from netweave.session import work_path
from netweave.sources import views
from netweave.streaming import jobs
from netweave.streaming.carry import CarryStream, replay, replay_files

DAY = 86_400_000_000
GAP = views.WIDE_GAP_US


def replayed(spark, df, parts=3, shuffled=False):
    path = work_path(spark, "test-stream")
    schema = replay_files(df, "ts_us", f"{path}/in", parts, shuffled)
    return replay(spark, f"{path}/in", schema), f"{path}/job"


def identity(df):
    return {tuple(r) for r in df.select("flow_id", "start_us", "end_us", "total_packets", "fwd_packets", "fwd_bytes").collect()}


def test_open_flows_wait_for_the_watermark(spark, small):
    packets = views.packets(spark, small)
    stream, path = replayed(spark, packets)
    job = CarryStream(spark, path, "ts_us", DAY, jobs.flow_step(GAP))
    job.run_available(stream, flush=False)
    batch = identity(flows.flows(packets, GAP))
    early = identity(jobs.finished_flows(job.output()))
    assert early < batch
    # A new driver goes on from the files alone.
    again = CarryStream(spark, path, "ts_us", DAY, jobs.flow_step(GAP))
    again.run_available(stream, flush=True)
    assert identity(jobs.finished_flows(again.output())) == batch
    with pytest.raises(RuntimeError, match="flushed"):
        again.run_available(stream)


def test_rows_behind_the_watermark_are_counted(spark, small):
    packets = views.packets(spark, small)
    stream, path = replayed(spark, packets, shuffled=True)
    job = jobs.stream_flows(spark, stream, path, delay_us=0, timeout_us=GAP)
    notes = job.notes().groupBy().sum("input_rows", "late_rows").first()
    assert notes[0] == packets.count() and notes[1] > 0
    kept = job.output().selectExpr("sum(n0 + n1)").first()[0]
    assert kept == notes[0] - notes[1]


def kept_by_walk(rows, window):
    last, kept = {}, set()
    for i, t, source, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        if (source, kind) not in last or t - last[source, kind] >= window:
            last[source, kind] = t
            kept.add(i)
    return kept


def test_dedup_on_engine_state_goes_on_after_a_restart(spark):
    rnd = random.Random(5)
    second = 1_000_000
    rows = [(i, 10**15 + rnd.randrange(600) * second // 2, rnd.choice([None, "a", "b"]), rnd.choice("xy")) for i in range(900)]
    rows += [(1000 + i, 10**15 + i * 61 * second, "beat", "x") for i in range(5)]
    kinds = "id long, ts_us long, source_ip string, attack_type string"
    path = work_path(spark, "test-dedup")
    # Rows of a file are up to 40 s out of order; the files come in two runs from one checkpoint.
    late = {r[0]: rnd.randrange(40) * second for r in rows}
    ordered = sorted(rows, key=lambda r: r[1] + late[r[0]])
    parts = [ordered[k * 151:(k + 1) * 151] for k in range(6)]
    end = [jobs.end_mark(max(r[1] for r in rows), 40 * second, 60 * second, spark.createDataFrame([], kinds).schema)]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in spark.createDataFrame([], kinds).schema])
    for files in (parts[:3], [*parts[3:], end]):
        for part in files:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        found = jobs.stream_dedup(replay(spark, f"{path}/in", schema), f"{path}/job", 40 * second, 60 * second)
    got = [r["id"] for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == kept_by_walk(rows, 60 * second)
    assert found.where("id is null").count() == 0


def test_allow_list_is_read_for_every_batch(spark, small):
    packets = views.packets(spark, small)
    everyone = packets.selectExpr("src_ip as ip_address").union(packets.selectExpr("dst_ip")).distinct()
    calls = []

    def listed():
        calls.append(1)
        return everyone if len(calls) > 2 else everyone.limit(0)

    stream, path = replayed(spark, packets)
    found = jobs.stream_detect(spark, stream, path, DAY, FixedRule(F.lit("DDoS")), listed, GAP, 0.5, GAP)
    passed = [spark.read.parquet(f"{path}/passed/batch={b}").count() for b in range(len(calls))]
    assert len(calls) > 2 and passed[1] > 0 and not any(passed[2:])
    assert 0 < found.count() <= sum(passed)


def test_late_rows_are_kept_apart(spark, small):
    packets = views.packets(spark, small)
    stream, path = replayed(spark, packets, shuffled=F.col("pkt_seq") % 3 == 0)
    job = jobs.stream_flows(spark, stream, path, delay_us=0, timeout_us=GAP)
    late = job.late(packets.schema)
    assert late.count() == job.notes().groupBy().sum("late_rows").first()[0] > 0
    assert late.where("pkt_seq % 3 <> 0").count() == 0
