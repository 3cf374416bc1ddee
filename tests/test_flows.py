import random
import statistics

import pytest
from pyspark.sql import functions as F

from netweave.operators import flows, packets

SCHEMA = ("pkt_seq long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
          "packet_length int, header_length int, tcp_flags int, tcp_window int")


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def tcp(seq, ts, forward=True, length=100, flags=0, window=0):
    ends = ("a", "b", 1000, 80) if forward else ("b", "a", 80, 1000)
    return (seq, ts, *ends, "TCP", length, 40, flags, window)


def walk(rows, timeout, icmp_literal=True):
    """Flows by going through the packets one by one."""
    open_flows, closed = {}, []
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        seq, ts, src, dst, sp, dp, proto, length, header, flags, window = r
        if proto == "OTHER":
            sp = dp = 0
        ends = ((src, sp), (dst, dp))
        key = (tuple(sorted(ends)), proto)
        flow = open_flows.get(key)
        if flow and ts - flow["times"][-1] >= timeout:
            closed.append(flow)
            flow = None
        if not flow:
            flow = open_flows[key] = {"ends": ends, "proto": proto, "times": [], "fwd": [], "bwd": []}
            forward = True
        else:
            forward = ends == flow["ends"]
            if proto == "ICMP" and icmp_literal and (flow["ends"][0][1], flow["ends"][1][1]) != (0, 0):
                forward = False
        flow["times"].append(ts)
        flow["fwd" if forward else "bwd"].append(r)
    return closed + list(open_flows.values())


def spread(times):
    gaps = [b - a for a, b in zip(times, times[1:])]
    return statistics.pstdev(gaps) if gaps else 0.0


def expected(flow):
    fwd, bwd, times = flow["fwd"], flow["bwd"], flow["times"]
    every = fwd + bwd
    tcp_only = flow["proto"] == "TCP"
    bits = lambda bit: float(sum(1 for r in every if tcp_only and r[9] & bit))
    total = sum(r[7] for r in every)
    duration = times[-1] - times[0]
    ftimes = [r[1] for r in fwd]
    return {
        "key": (times[0], *flow["ends"], flow["proto"]), "n": len(every), "fwd": len(fwd),
        " Fwd Packet Length Mean": sum(r[7] for r in fwd) / len(fwd),
        " Fwd Packet Length Max": float(max(r[7] for r in fwd)),
        " Bwd Packet Length Mean": sum(r[7] for r in bwd) / len(bwd) if bwd else 0.0,
        " Fwd IAT Mean": (ftimes[-1] - ftimes[0]) / (len(ftimes) - 1) if len(ftimes) > 1 else 0.0,
        " Fwd IAT Std": spread(ftimes), " Flow IAT Std": spread(times),
        " Fwd Header Length": float(sum(r[8] for r in fwd)), " Bwd Header Length": float(sum(r[8] for r in bwd)),
        "Init_Win_bytes_forward": float(fwd[0][10]) if tcp_only else 0.0,
        " Init_Win_bytes_backward": float(bwd[0][10]) if bwd and tcp_only else 0.0,
        " PSH Flag Count": bits(8), " ACK Flag Count": bits(16), " Flow Duration": float(duration),
        "Flow Bytes/s": total * 1e6 / duration if duration else 0.0,
    }


def check(spark, rows, timeout, span, icmp_literal=True):
    found = flows.with_features(flows.flows(make(spark, rows), timeout, icmp_literal, span)).collect()
    wanted = {e["key"]: e for e in map(expected, walk(rows, timeout, icmp_literal))}
    assert len(found) == len(wanted)
    for r in found:
        e = wanted[r["start_us"], (r["src_ip"], r["src_port"]), (r["dst_ip"], r["dst_port"]), r["protocol"]]
        assert (r["total_packets"], r["fwd_packets"]) == (e["n"], e["fwd"])
        for name in [n for n in e if n in r.asDict()]:
            assert r[name] == pytest.approx(e[name], rel=1e-9, abs=1e-9), name


def random_rows(seed, count, protocols=("TCP", "UDP", "ICMP", "OTHER")):
    rnd = random.Random(seed)
    rows = []
    for i in range(count):
        a, b = rnd.choice([("a", "b"), ("b", "a"), ("a", "a"), ("a", "c")])
        proto = rnd.choice(protocols)
        ports = (rnd.choice([0, 8]), 0) if proto == "ICMP" else rnd.choice([(1, 2), (2, 1), (2, 2)])
        rows.append((i, rnd.randrange(3000), a, b, *ports, proto, rnd.randrange(40, 1500), 40,
                     rnd.randrange(64), rnd.randrange(65536)))
    return rows


@pytest.mark.parametrize("span", [7, 100, 10_000])
@pytest.mark.parametrize("icmp_literal", [True, False])
def test_flows_match_a_walk_whatever_the_span(spark, span, icmp_literal):
    check(spark, random_rows(1, 600), 40, span, icmp_literal)


def test_one_hot_key_spread_over_many_spans(spark):
    rnd = random.Random(5)
    check(spark, [tcp(i, rnd.randrange(20_000), rnd.random() < 0.6, rnd.randrange(40, 99)) for i in range(3000)], 60, 500)


@pytest.mark.parametrize("gap, count", [(4_999_999, 1), (5_000_000, 2)])
def test_a_gap_of_the_timeout_closes_the_flow(spark, gap, count):
    for span in (1_000_000, 60_000_000):
        assert flows.flows(make(spark, [tcp(1, 0), tcp(2, gap)]), span_us=span).count() == count


def test_single_packet_and_zero_duration(spark):
    one = flows.with_features(flows.flows(make(spark, [tcp(1, 5)]))).first()
    assert [one[c] for c in (" Flow IAT Std", " Fwd IAT Mean", "Flow Bytes/s", " Flow Duration")] == [0.0] * 4
    two = flows.with_features(flows.flows(make(spark, [tcp(1, 5), tcp(2, 5, False)]))).first()
    assert (two["total_packets"], two["Flow Bytes/s"], two["bwd_packets"]) == (2, 0.0, 1)


def test_icmp_request_and_reply_are_two_flows(spark):
    rows = [(1, 0, "a", "b", 8, 0, "ICMP", 60, 28, 0, 0), (2, 10, "b", "a", 0, 0, "ICMP", 60, 28, 0, 0)]
    assert flows.flows(make(spark, rows)).count() == 2


@pytest.mark.parametrize("span", [13, 10_000])
def test_packet_assignment_matches_a_walk(spark, span):
    rows = random_rows(2, 500)
    found = {r["pkt_seq"]: r for r in flows.packet_flows(make(spark, rows), 40, True, span).collect()}
    assert len(found) == len(rows)
    for flow in walk(rows, 40):
        for side, forward in (("fwd", True), ("bwd", False)):
            before = None
            for r in flow[side]:
                mine = found[r[0]]
                assert (mine["start_us"], mine["is_forward"]) == (flow["times"][0], forward)
                assert mine["side_iat_us"] == (None if before is None else r[1] - before)
                before = r[1]


def test_records_without_addresses_have_no_flow(spark):
    rows = [(1, 0, None, None, 0, 0, "OTHER", 60, 14, 0, 0)]
    assert packets.with_flow_key(make(spark, rows)).count() == 0


def test_header_length(spark):
    row = spark.sql("select 'TCP' p").select(
        packets.header_length(F.col("p"), F.lit(5), F.lit(8)).alias("t"),
        packets.header_length(F.lit("UDP"), F.lit(5), F.lit(0)).alias("u"),
        packets.header_length(F.lit("OTHER"), F.lit(6), F.lit(0)).alias("o")).first()
    assert tuple(row) == (52, 28, 24)


def test_packet_rows_are_shuffled_once(spark, small):
    from netweave.sources import views

    plan = flows.flows(views.packets(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "BatchEvalPython" not in plan
