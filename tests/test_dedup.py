import random

import pytest

from netweave.operators import cascade, dedup

MIN = 60_000_000


def walk(rows, window, last=None):
    last, kept = dict(last or {}), set()
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or t - last[k] >= window:
            last[k] = t
            kept.add((k, t, i))
    return kept


def run(spark, rows, window, **more):
    df = spark.createDataFrame(rows, "k string, t long, i long")
    return {tuple(r) for r in dedup.kept_moments(df, ["k"], "t", "i", window, **more).select("k", "t", "i").collect()}


def test_documented_example(spark):
    rows = [("x", 0, 1), ("x", 30_000_000, 2), ("x", 65_000_000, 3)]
    assert run(spark, rows, MIN) == {rows[0], rows[2]}


def test_exactly_one_window_later_is_kept(spark):
    rows = [("x", 0, 1), ("x", MIN - 1, 2), ("y", 0, 3), ("y", MIN, 4)]
    assert run(spark, rows, MIN) == {rows[0], rows[2], rows[3]}


def test_other_type_or_source_is_new(spark):
    rows = [("50DDoS", 0, 1), ("50PortScan", 1, 2), ("51DDoS", 2, 3)]
    assert run(spark, rows, MIN) == set(rows)


@pytest.mark.parametrize("levels", [0, 1, 2, None])
@pytest.mark.parametrize("window", [3, 61, 500])
def test_matches_a_walk_with_a_hot_key(spark, levels, window):
    rnd = random.Random(window)
    rows = [(rnd.choice("aaaab"), rnd.randrange(-5000, 25_000), i) for i in range(6000)]
    assert run(spark, rows, window, levels=levels) == walk(rows, window)


def test_sparse_rows_and_regular_beat(spark):
    rows = [("a", t, t) for t in range(0, 100_000, 997)] + [("b", t, t) for t in range(0, 5000, 10)]
    assert run(spark, rows, 100, levels=1) == walk(rows, 100)


def test_goes_on_from_an_earlier_state(spark):
    rows = [("a", 50, 1), ("a", 110, 2), ("b", 10, 3)]
    state = spark.createDataFrame([("a", 20)], "k string, last_kept long")
    assert run(spark, rows, 60, previous=state) == walk(rows, 60, {"a": 20})


@pytest.mark.parametrize("levels", [0, 1, 2])
@pytest.mark.parametrize("window", [10, 61])
def test_goes_on_from_a_state_inside_any_block(spark, levels, window):
    rnd = random.Random(window + levels)
    keys = [f"k{i}" for i in range(40)]
    rows = [(rnd.choice(keys), rnd.randrange(0, 40 * window), i) for i in range(3000)]
    state = {k: rnd.randrange(-window, 30 * window) for k in keys[:35]}
    given = spark.createDataFrame(list(state.items()), "k string, last_kept long")
    assert run(spark, rows, window, levels=levels, previous=given) == walk(rows, window, state)


def test_empty_input(spark):
    assert run(spark, [], 60) == set()


def test_cascade_keeps_order_of_steps(spark):
    scored = spark.createDataFrame([
        (1, 0, "s", "d", "DDoS", 0.90), (2, 10, "s", "d", "DDoS", 0.96), (3, 20, "s", "d", "DDoS", 0.99),
        (4, 30, "w", "d", "DDoS", 0.99), (5, 40, "s", "d", "BENIGN", 0.99)],
        "id long, ts_us long, source_ip string, dest_ip string, attack_type string, confidence double")
    allow = spark.createDataFrame([("w",)], "ip_address string")
    assert [r["id"] for r in cascade.new_alerts(scored, allow).collect()] == [2]
    row = cascade.funnel(scored, allow).first().asDict()
    assert row == {"total_predictions": 5, "benign_filtered": 1, "low_confidence_skipped": 1,
                   "whitelist_skipped": 1, "duplicates_blocked": 1, "alerts_created": 1,
                   "dos_hulk": 0, "portscan": 0, "ddos": 1}


def test_expired_entries_are_older_than_the_window(spark):
    cache = spark.createDataFrame([("a", 39), ("b", 40)], "k string, last_kept long")
    assert [r["k"] for r in dedup.expired_entries(cache, 100, 60).collect()] == ["a"]
    assert [r["k"] for r in dedup.live_entries(cache, 100, 60).collect()] == ["b"]


def test_python_parts_run_where_the_package_is_not(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    file = tmp_path / "f"
    file.write_bytes(cloudpickle.dumps(dedup._pick_mapper(["k"], 1)))
    code = f"from pyspark import cloudpickle; print(list(cloudpickle.loads(open({str(file)!r}, 'rb').read())([])))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == "[]", done.stderr
