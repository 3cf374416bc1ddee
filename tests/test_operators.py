import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netweave import constants
from netweave.functions import quantiles, scalars
from netweave.operators import (
    alerts, balance, clean, evaluation, membership, prep, profile, records, selection, training,
)

INF, NAN = float("inf"), float("nan")
NOW = datetime(2025, 11, 10, 12, 0)


def stored(spark, rows):
    rows = [(i, t, scalars.micros(t), s, "10.0.0.1", a, c, "critical" if c >= 0.95 else "low")
            for i, (t, s, a, c) in enumerate(rows, 1)]
    return spark.createDataFrame(rows, "id long, ts timestamp, ts_us long, source_ip string, dest_ip string, "
                                       "attack_type string, confidence double, severity string")


@pytest.fixture(scope="module")
def three(spark):
    return stored(spark, [(NOW, "a", "DDoS", 0.98), (NOW - timedelta(hours=1), "b", "PortScan", 0.92),
                          (NOW - timedelta(hours=2), "a", "DoS Hulk", 0.96)])


def test_search_and_counts(three):
    assert alerts.count(alerts.search(three, severity="critical")).first()[0] == 2
    assert alerts.count(alerts.search(three, source_ip="a", start=NOW - timedelta(minutes=1))).first()[0] == 1
    assert [r["id"] for r in alerts.recent(three, 2).collect()] == [1, 2]
    assert alerts.last_hours(three, NOW, 1).first().asDict()["total_alerts"] == 2


def test_pages(three):
    assert alerts.page(three, 2, 2).count() == 1 and alerts.page(three, 9, 2).count() == 0
    meta = alerts.page_meta(three, 2, 2).first()
    assert (meta["total"], meta["pages"], meta["has_next"], meta["has_prev"]) == (3, 2, False, True)
    assert alerts.page_meta(three.where("id < 0"), 1, 50).first()["pages"] == 1
    with pytest.raises(ValueError):
        alerts.page(three, 1, 201)


@pytest.mark.parametrize("period, buckets", [("hour", 13), ("day", 25), ("week", 8)])
def test_timeline_has_one_interval_more(three, period, buckets):
    rows = {r["bucket"]: r for r in alerts.timeline(three, NOW, period).collect()}
    assert len(rows) == buckets and rows[buckets - 1]["total"] == 1
    assert rows[buckets - 1]["start_time"] == "2025-11-10T12:00:00"


def test_alerts_later_than_the_moment(spark):
    late = stored(spark, [(NOW + timedelta(hours=30), "a", "DDoS", 0.98)])
    assert alerts.timeline_summary(late, NOW, "day").first()["total_alerts"] == 1
    assert sum(r["total"] for r in alerts.timeline(late, NOW, "day").collect()) == 0


def test_lists_and_settings(spark):
    old = spark.createDataFrame([(1, "a", "x", 5)], "id long, ip_address string, description string, added_us long")
    new = spark.createDataFrame([(2, "a", "y", 6), (3, "b", "z", 8), (4, "b", "w", 7)], old.schema)
    assert {(r["ip_address"], r["description"]) for r in records.list_insert(old, new).collect()} == {("a", "x"), ("b", "w")}
    log = spark.createDataFrame([(1, "k", "1", 1), (2, "k", "2", 2)],
                                "id long, config_key string, config_value string, updated_us long")
    assert records.setting(log, "k").first()["config_value"] == "2"
    assert records.setting(log, "none", "d").first()["config_value"] == "d"
    assert records.settings_without(log, log.limit(1)).count() == 0
    assert sorted(r["id"] for r in records.next_ids(log, log, ["updated_us", "id"]).collect()) == [3, 4]


@pytest.mark.parametrize("small", [True, False])
def test_membership_is_the_same_broadcast_or_salted(spark, small):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("ip"))
    listed = spark.createDataFrame([("hot",), ("3",), ("hot",)], "ip_address string")
    assert membership.only_members(df, "ip", listed, "ip_address", small).count() == 667
    assert membership.without_members(df, "ip", listed, "ip_address", small).count() == 333
    tagged = membership.tag_members(df, "ip", listed, "ip_address", "on", small)
    assert tagged.count() == 1000 and tagged.where("on").count() == 667


def test_repairs(spark):
    df = spark.createDataFrame(
        [(1.0, INF, None, "DDoS"), (INF, -INF, None, "DDoS"), (-INF, INF, None, "BENIGN"), (NAN, INF, None, "odd")],
        "a double, b double, c double, label string")
    top = clean.finite_maxima(df)
    assert top == {"a": 1.0, "b": 0.0, "c": 0.0}
    fixed = clean.clean(df).collect()
    assert [r["a"] for r in fixed] == [1.0] * 4 and {r["b"] for r in fixed} == {0.0} and {r["c"] for r in fixed} == {None}
    valid = clean.validate(df).collect()
    assert len(valid) == 3 and {r["a"] for r in valid} == {1.0}
    assert {r["column_name"]: r["missing_count"] for r in profile.missing_profile(df).collect()} == {"a": 1, "c": 4}
    assert [tuple(r) for r in profile.infinity_profile(df).collect()] == [("b", 4), ("a", 2)]
    assert clean.unexpected_labels(df).first()["label"] == "odd"
    assert clean.scorable_rows(df, ["a"]).count() == 1 and clean.invalid_rows(df, ["a"]).count() == 1


def test_column_choice(spark):
    df = spark.createDataFrame([(1, 2, 3)], "` a` int, b int, c int")
    assert clean.select_features(df, ["b", "a", "gone"]).columns == ["b", " a"]
    with pytest.raises(ValueError):
        clean.select_features(df, ["x", "y", "b"])
    assert profile.literature_matches([" Flow Duration"])["Flow Duration"] == " Flow Duration"
    assert profile.name_groups([" Fwd IAT Mean"])["time"] == [" Fwd IAT Mean"]
    assert profile.dtype_counts(df) == {"int": 3}


@pytest.mark.parametrize("limit", [5, 60, 100_000])
def test_order_statistics_are_exact(spark, limit):
    values = [float((i * 7919) % 1009) if i % 5 else 3.0 for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ranks = [1, 2, 700, 1500, 2999, 3000]
    found = quantiles.order_statistics(df, {"x": F.col("x")}, {"x": ranks}, {"x": 3000}, limit)
    assert [found["x", r] for r in ranks] == [sorted(values)[r - 1] for r in ranks]
    assert quantiles.exact_medians(df, {"x": F.col("x")}, limit)["x"] == sum(sorted(values)[1499:1501]) / 2


def test_labels(spark):
    df = spark.createDataFrame([("BENIGN",), ("DDoS",)], "label string")
    assert [r["label_id"] for r in prep.encode_labels(df).orderBy("label").collect()] == [0, 3]
    with pytest.raises(Exception, match="no id for label"):
        prep.encode_labels(df.union(spark.createDataFrame([("odd",)], "label string"))).collect()
    gap = spark.createDataFrame([(0,)] * 40 + [(2,)] * 30 + [(3,)] * 30, "label_id int")
    found = {tuple(r) for r in prep.remap_labels(gap).collect()}
    assert found == {(0, 0), (2, 1), (3, 2)}


def test_split_shares_and_scaler(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("key"),
                                  F.when(F.col("id") < 800, "BENIGN").otherwise("DDoS").alias("label"),
                                  F.lit(4.0).alias("flat"))
    parts = prep.stratified_split(df, "label", "key", ["id"])
    counted = {(r["label"], r["part"]): r["count"] for r in parts.groupBy("label", "part").count().collect()}
    assert counted == {("BENIGN", "test"): 160, ("BENIGN", "validation"): 80, ("BENIGN", "train"): 560,
                       ("DDoS", "test"): 40, ("DDoS", "validation"): 20, ("DDoS", "train"): 140}
    assert prep.fit_scaler(df, ["flat"]) == {"flat": (4.0, 1.0)}
    assert [r["id"] for r in prep.head_sample(df, ["key", "id"], 0.005).orderBy("id").collect()] == [0, 7, 14, 21, 28]


def test_golden_matrix(spark):
    # A published confusion matrix and the figures that belong to it.
    counts = [[454344, 70, 194, 12], [3, 46211, 1, 0], [3, 9, 31774, 0], [5, 0, 0, 25600]]
    figures = {
        "BENIGN": (0.9999757898559496, 0.9993928995644714, 0.9996842597431173, 454620),
        "DoS Hulk": (0.9982933678980341, 0.9999134480147138, 0.9991027512026377, 46215),
        "PortScan": (0.9939003409553004, 0.9996224753035928, 0.9967531958277782, 31786),
        "DDoS": (0.9995314696236139, 0.9998047256395235, 0.9996680789581585, 25605),
        "macro avg": (0.9979252420832245, 0.9996833871305755, 0.998802071432923, 558226),
        "weighted avg": (0.9994701807136128, 0.9994679574222627, 0.9994684770246302, 558226),
    }
    names = constants.CLASSES
    matrix = spark.createDataFrame(
        [(names[i], names[j], n) for i, line in enumerate(counts) for j, n in enumerate(line)],
        "truth string, predicted string, n long")
    report = {r["class_name"]: r for r in evaluation.classification_report(matrix).collect()}
    for name, wanted in figures.items():
        r = report[name]
        assert (r["precision"], r["recall"], r["f1_score"], r["support"]) == pytest.approx(wanted, abs=1e-12)
    assert report["accuracy"]["f1_score"] == pytest.approx(0.9994679574222627, abs=1e-12)
    errors = {r["class_name"]: r for r in evaluation.class_errors(matrix).collect()}
    assert errors["BENIGN"]["false_positives"] == 11 and errors["BENIGN"]["false_negatives"] == 276
    assert all(r["passed"] for r in evaluation.quality_gates(matrix).collect())
    assert evaluation.metrics_document(matrix).first()["confusion_matrix"] == counts


def test_feature_choice(spark):
    blended = spark.createDataFrame([(f"f{i}", 10.0 - i) for i in range(6)], "feature string, final_score double")
    pick = lambda **k: [r["feature"] for r in selection.select_top(blended, 3, **k).orderBy("position").collect()]
    assert pick(critical=["f4", "f5", "none"]) == ["f0", "f1", "f5"]
    assert pick(critical=["f0"]) == ["f0", "f1", "f2"]
    assert pick(critical=["f4", "f5"], preserve_all=True) == ["f0", "f4", "f5"]


def test_blend_keeps_flat_methods(spark):
    scores = spark.createDataFrame([("univariate", "a", 2.0), ("univariate", "b", 2.0), ("mutual_info", "a", 1.0),
                                    ("mutual_info", "b", 3.0), ("mutual_info", "c", 9.0)],
                                   "method string, feature string, score double")
    found = {r["feature"]: r["final_score"] for r in selection.blend_scores(scores, ["univariate", "mutual_info"]).collect()}
    assert found == pytest.approx({"a": 0.3, "b": 0.3 + 0.15 * 0.25})


def test_synthetic_rows(spark):
    rows = [(i, float(i % 10), float(i // 10), 0 if i < 60 else 1) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, x double, y double, label_id int")
    filled = balance.smote(df, ["x", "y"], ["id"])
    assert {r["label_id"]: r["count"] for r in filled.groupBy("label_id").count().collect()} == {0: 60, 1: 60}
    made = filled.where("is_synthetic").collect()
    assert all(r["label_id"] == 1 and 0 <= r["x"] <= 9 and 6 <= r["y"] <= 7 for r in made)


def test_synthetic_rows_of_odd_classes(spark, monkeypatch):
    monkeypatch.setattr(balance, "STRETCH", 16)
    rows = [(i, float(i % 10), float(i // 10), i % 2) for i in range(90)] + [(100, 5.0, 5.0, 2), (101, 1.0, 1.0, None), (102, 1.0, 3.0, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double, label_id int")
    filled = balance.smote(df, ["x", "y"], ["id"])
    assert {r["label_id"]: r["count"] for r in filled.groupBy("label_id").count().collect()} == {0: 45, 1: 45, 2: 45, None: 45}
    lone = filled.where("label_id = 2").select("x", "y").distinct().collect()
    assert [tuple(r) for r in lone] == [(5.0, 5.0)]


def test_neighbours_are_mostly_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(balance, "STRETCH", 64)
    import numpy as np
    rng = np.random.default_rng(3)
    points = rng.normal(size=(400, 3)) * [1, 10, 100]
    df = spark.createDataFrame([(i, *map(float, p), 1) for i, p in enumerate(points)], "id long, x double, y double, z double, label_id int")
    scaled = (points - points.mean(0)) / points.std(0)
    hits = 0
    for r in balance.nearest(df, ["x", "y", "z"], ["id"], "label_id").collect():
        d = ((scaled - scaled[r["id"]]) ** 2).sum(1)
        d[r["id"]] = np.inf
        best = {tuple(points[k]) for k in np.argsort(d)[:6]}
        hits += sum(tuple(p) in best for p in r["near"])
    assert hits / (400 * 3) > 0.3


def test_no_row_vanishes(spark):
    df = spark.createDataFrame([("BENIGN", "BENIGN"), ("BENIGN", None), (None, "DDoS"), ("odd", "odd")], "truth string, predicted string")
    matrix = evaluation.confusion_matrix(df)
    assert matrix.groupBy().sum("n").first()[0] == 4
    report = {r["class_name"]: r["f1_score"] for r in evaluation.classification_report(matrix).collect()}
    assert report["accuracy"] == 0.5
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else "ab"[i % 2], None if i % 3 == 0 else i % 3) for i in range(90)], "id long, label string, label_id int")
    split = prep.stratified_split(rows, "label", "id", ["id"])
    assert split.count() == 90 and split.where("label is null and part = 'test'").count() == 2
    assert prep.remap_labels(rows).groupBy("remapped").count().count() == 3


def test_head_sample_compares_in_own_types(spark):
    big = 2**53
    rows = [(None, 5), (None, 6), ("a", big + 1), ("a", big), ("b", 1)]
    df = spark.createDataFrame(rows, "name string, id long")
    assert [tuple(r) for r in prep.head_sample(df, ["name", "id"], 0.6).orderBy("id").collect()] == [(None, 5), (None, 6), ("a", big)]


def test_sessions_and_dedup_keep_null_keys(spark):
    from netweave.operators import dedup, sessions

    rows = [(None, 0, 1), (None, 5, 2), (None, 200, 3), ("a", 0, 4)]
    df = spark.createDataFrame(rows, "key string, ts_us long, id long")
    found = sessions.assign_sessions(df, ["key"], "ts_us", "id", 100, {}, span_us=50)
    assert sorted((r["id"], r["session_no"]) for r in found.collect()) == [(1, 1), (2, 1), (3, 2), (4, 1)]
    kept = dedup.greedy_dedup(df, ["key"], "ts_us", "id", 100)
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 4]


def test_published_metrics_are_read(spark, tmp_path):
    from netweave.sources import documents

    entry = {"precision": 0.5, "recall": 1.0, "f1-score": 0.75, "support": 4.0}
    told = {"validation": {"accuracy": 0.9, "classification_report": {"DDoS": entry, "accuracy": 0.9}, "confusion_matrix": [[1, 2]]}}
    (tmp_path / "m.json").write_text(json.dumps(told, indent=2))
    rows = evaluation.flatten_metrics(documents.read_metrics(spark, str(tmp_path))).collect()
    assert {(r["split"], r["class_name"], r["metric"], r["value"]) for r in rows} == {
        ("validation", "DDoS", "precision", 0.5), ("validation", "DDoS", "recall", 1.0), ("validation", "DDoS", "f1-score", 0.75),
        ("validation", "DDoS", "support", 4.0), ("validation", "accuracy", "accuracy", 0.9)}


def test_csv_columns_go_by_name(spark, tmp_path):
    from netweave.sources import csv_flows

    (tmp_path / "a.csv").write_text("x,y,label\n1,2,p\n")
    (tmp_path / "b.csv").write_text("y,x,label,more\n4,3,q,z\n")
    (tmp_path / "c.csv").write_text("x,label\n5,r\n")
    rows = csv_flows.read_flows(spark, str(tmp_path), "x double, y double, label string").orderBy("x").collect()
    assert [tuple(r) for r in rows] == [(1.0, 2.0, "p"), (3.0, 4.0, "q"), (5.0, None, "r")]
    assert csv_flows.read_flows(spark, str(tmp_path)).columns == ["x", "y", "label", "more"]


def test_classifiers_learn_and_survive_saving(spark, small):
    from netweave.plans.learning import learnable, split
    from netweave.session import work_path
    from netweave.sources.views import FLOW_NUMERIC

    rows = split(learnable(spark, small)).cache()
    for kind, rounds in (("forest", 20), ("boosted", 12)):
        model = training.train(rows, FLOW_NUMERIC, kind, rounds=rounds, depth=6, subsample=1.0)
        test = model.score(rows.where("part = 'test'"))
        good = test.where("label = attack_type").count() / test.count()
        assert good >= 0.95, (kind, good)
        assert test.where("confidence < 0.25 or confidence > 1").count() == 0
        path = work_path(spark, "saved")
        model.save(spark, path)
        again = training.Classifier.load(spark, path).score(rows.where("part = 'test'"))
        assert again.where("label = attack_type").count() / again.count() == good
    assert training.combinations() == 48


def test_scalars(spark):
    row = spark.sql("select '2025-11-10T08:00:00Z' a, '2025-13-40' b, 'x' c").select(
        scalars.parse_iso(F.col("a")).cast("string").alias("a"), scalars.parse_iso(F.col("b")).alias("b"),
        scalars.parse_iso(F.col("c")).alias("c"), scalars.duration_text(F.lit(3725)).alias("d"),
        scalars.duration_text(F.lit(61.5)).alias("e"), scalars.duration_text(F.lit(9)).alias("f"),
        scalars.looks_like_ipv4(F.lit("10.0.0.256")).alias("g"), scalars.looks_like_ipv4(F.lit("255.1.2.3")).alias("h"),
        scalars.ratio(F.lit(1), F.lit(0)).alias("i")).first()
    assert tuple(row) == ("2025-11-10 08:00:00", None, None, "1h 2m 5s", "1m 1s", "9s", False, True, 0.0)


def test_folds_are_stratified(spark):
    rows = [(i % 50 == 0, 0 if i % 50 else 1 + i % 3, float(i)) for i in range(1000)]
    df = spark.createDataFrame([(int(a), b, c) for a, b, c in rows], "odd int, label_id int, key double")
    placed = training.with_fold(df, "key").groupBy("label_id", "fold").count().collect()
    for label in {r.label_id for r in placed}:
        sizes = [r["count"] for r in placed if r.label_id == label]
        assert len(sizes) == constants.TUNING_FOLDS and max(sizes) - min(sizes) <= 1


def test_registered_search_takes_the_declared_grid(monkeypatch):
    from netweave.plans import learning

    told = {}

    def stop(*args, **named):
        told.update(named)
        raise InterruptedError

    monkeypatch.setattr(learning, "learnable", lambda *a: None)
    monkeypatch.setattr(learning, "prepared", lambda *a: a[-1]())
    monkeypatch.setattr(training, "grid_search", stop)
    with pytest.raises(InterruptedError):
        learning.grid_search(None, None)
    assert "grid" not in told and told["fit_rows"] == learning.GRID_ROWS
