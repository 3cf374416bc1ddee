"""What must not grow with the rows: tasks by class, tables written on the way."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from netweave.operators import balance, cascade, prep, training
from netweave.streaming import suppress


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_class_is_not_one_tasks_work(spark):
    df = spark.range(300).selectExpr("id", "cast(case when id % 3 < 2 then id % 3 * 5 end as int) label_id")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = prep.remap_labels(df)
        assert "BroadcastHashJoin" in plan_of(found)
        assert {tuple(r) for r in found.select("label_id", "remapped").collect()} == {(0, 0), (5, 1), (None, None)}
        many = prep.remap_labels(spark.range(prep.FEW_IDS + 1).selectExpr("cast(id * 2 as int) label_id"))
        assert "BroadcastHashJoin" not in plan_of(many)
        assert many.where("remapped = label_id / 2").count() == prep.FEW_IDS + 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_cleaned_and_split_flows_are_not_written(spark, small):
    from netweave.plans import cleaning, learning

    for rows, ends in ((cleaning.split_flows(spark, small), "split-ends"), (learning.trained_rows(spark, small), "learnable-ends")):
        assert all("lineitem.parquet" in f or ends in f for f in rows.inputFiles())
        assert rows.groupBy("part").count().count() == 3
    assert all("lineitem.parquet" in f for f in cleaning.cleaned(spark, small).inputFiles())
    assert all("lineitem.parquet" in f for f in learning.learnable(spark, small).inputFiles())


def test_ranks_of_first_equal_rows(spark):
    rows = [(None, 1, 2.0), ("a", 1, 5.0), ("a", 1, 5.0), ("a", 1, 4.0), ("b", None, 1.0), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, l int, x double").repartition(4)
    found = prep.ranked(df, ["k", "l", "x"], ["k", "x"], {"of_two": 2, "of_all": 3}).orderBy("_rank").collect()
    assert [tuple(r) for r in found] == [
        (None, 2.0, 0, 0, 0), (None, 2.0, 1, 0, 0), ("a", 4.0, 2, 2, 2), ("a", 5.0, 3, 2, 3), ("a", 5.0, 4, 2, 3), ("b", 1.0, 5, 5, 5)]


def test_neighbours_travel_as_numbers(spark, monkeypatch):
    monkeypatch.setattr(balance, "STRETCH", 16)
    rows = [(i % 70, float(i % 70 % 9), float(i % 70 // 9), i % 70 % 2) for i in range(80)]  # ten rows twice
    df = spark.createDataFrame(rows, "id long, x double, y double, label_id int")
    numbered = balance.numbered(df, ["x", "y"], ["id"], "label_id")
    found = balance.closest(numbered, [(0.0, 1.0), (0.0, 1.0)], "label_id")
    assert dict(found.dtypes) == {"_id": "bigint", "_near": "array<bigint>"}
    # As before, a row that is there twice is its own neighbour, and equal rows count once.
    at = {r["_me"]: (r["id"], r["_f0"], r["_f1"], r["label_id"]) for r in numbered.collect()}
    near = {at[r["_id"]][0]: r["_near"] for r in found.collect()}
    assert len(near) == 70 and all(len(set(n)) == len(n) for n in near.values())
    assert all((k in [at[m][0] for m in n]) == (k < 10) for k, n in near.items())
    assert all(at[m][3] == k % 2 for k, n in near.items() for m in n)


@pytest.mark.parametrize("parts", [2, 40])
def test_only_wanted_rows_keep_their_closest(spark, monkeypatch, parts):
    monkeypatch.setattr(balance, "STRETCH", 5)
    plain = [(i % 50, None if i % 50 % 3 == 0 else f"c{i % 50 % 3}", float(i % 50 * 7 % 11), float(i % 50 * 5 % 13)) for i in range(60)]  # ten rows twice
    df = spark.createDataFrame(plain, "id long, label string, x double, y double")
    scaler = [(1.0, 2.0), (0.5, 3.0)]
    rows, written, write = balance.numbered(df, ["x", "y"], ["id"], "label"), [], balance.pinned

    def pinned(df, purpose):
        out = write(df, purpose)
        written.append(out)
        return out

    monkeypatch.setattr(balance, "pinned", pinned)
    known = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["_id"]: r["_near"] for r in balance.closest(rows, scaler, "label", wanted=F.col("_id") % 2 == 0).collect()}
    finally:
        for c, v in known.items():
            spark.conf.set(c, v)
    assert sum(t.where("_part is null").count() for t in written) == balance.LINES * sum(r["_id"] % 2 == 0 for r in rows.collect())
    points = [(r["label"] or "", r["_id"], r["_me"], (r["_f0"] - 1.0) / 2.0, (r["_f1"] - 0.5) / 3.0) for r in rows.collect()]
    offers = {p[1]: set() for p in points if p[1] % 2 == 0}
    for line in balance._lines(2, balance.SPLIT_SEED):
        for label in {p[0] for p in points}:
            order = sorted((p for p in points if p[0] == label), key=lambda p: (0.0 + p[3] * line[0] + p[4] * line[1], *p[1:3]))
            for i, p in enumerate(order):
                for q in order[max(0, i - 3):i] + order[i + 1:i + 4]:
                    if p[1] in offers:
                        offers[p[1]].add(((p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2, q[2]))
    assert found == {k: [m for _, m in sorted(of)[:3]] for k, of in offers.items()}


def test_the_search_reads_its_few_rows_and_not_the_table(spark, tmp_path, monkeypatch):
    whole = str(tmp_path / "whole")
    spark.range(300).selectExpr("id key", "cast(id % 7 as double) a", "cast(id % 3 as int) label_id").write.parquet(whole)
    seen = []

    def fold(df, key, label="label_id", folds=5):
        seen.extend(df.inputFiles())
        assert 0 < df.count() <= 300
        raise InterruptedError

    monkeypatch.setattr(training, "with_fold", fold)
    with pytest.raises(InterruptedError):
        training.grid_search(spark.read.parquet(whole), ["a"], "key", {"n_estimators": [1]}, fit_rows=100)
    assert seen and not any(whole in f for f in seen)


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_registered_fits_take_all_rows(spark, monkeypatch, kind):
    from netweave.plans import learning

    df = spark.range(25_000).selectExpr("id", "cast(id % 7919 as double) a", "cast(id % 3 as int) label_id", "if(id < 24000, 'train', 'test') part")
    seen = []

    def stop(rows, purpose):
        seen.append((purpose, rows.count()))
        raise InterruptedError

    monkeypatch.setattr(learning, "trained_rows", lambda *a: df)
    monkeypatch.setattr(learning, "remembered", lambda *a: a[-1]())
    monkeypatch.setattr(learning, "FLOW_NUMERIC", ["a"])
    monkeypatch.setattr(training, "written", stop)
    with pytest.raises(InterruptedError):
        learning.trained(spark, None, kind)
    assert seen == [("fit-rows", 24_000)]


def test_streamed_detection_learns_from_all_flows(spark, small, monkeypatch):
    from netweave.plans import streams

    told = {}

    def stop(df, features, **named):
        told.update(named, rows=df.count())
        raise InterruptedError

    monkeypatch.setattr(training, "train", stop)
    with pytest.raises(InterruptedError):
        streams.stream_detect(spark, small)
    assert told["rows"] and told.get("fit_rows") is None


def test_a_forest_is_asked_once_per_row(spark):
    df = spark.range(60).selectExpr("id", "cast(id % 7 as double) a", "cast(id % 5 as double) b", "cast(id % 3 as int) label_id")
    model = training.train(df, ["a", "b"], rounds=2, depth=2, part=None)
    scored = model.score_valid(df)
    sure = cascade.suspicious(scored, 0.4).select("id", "attack_type", "confidence")
    assert plan_of(sure).count("UDF(UDF(") == 1
    want = {(r.id, r.attack_type, r.confidence) for r in scored.collect() if r.attack_type != "BENIGN" and r.confidence >= 0.4}
    assert want and {tuple(r) for r in sure.collect()} == want


class State:
    """A group's state as the engine hands it over."""

    def __init__(self):
        self.value, self.wake, self.mark = None, None, 0

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentWatermarkMs(self):
        return self.mark // 1000

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, ms):
        self.wake = ms


def test_keys_share_a_state_and_not_their_times():
    walk, state = suppress._walk(10_000), State()

    def call(rows, mark):
        state.mark = mark
        frame = pd.DataFrame(rows, columns=["_time", "_tie", "_row", "_key"])
        return sorted(k for f in walk((0,), iter([frame]), state) for k in f["kept"])

    assert call([(5_000, 1, "a1", "a"), (6_000, 2, "b1", "b"), (9_000, 3, "a2", "a")], 0) == [] and state.wake == 6
    assert call([(30_000, 4, "b2", "b")], 20_000) == ["a1", "b1"] and state.wake == 31
    assert call([(30_000, 5, "a3", "a")], 20_000) == []
    assert call([], 31_000) == ["a3", "b2"] and state.wake == 41
    assert call([], 41_000) == [] and not state.exists
