"""The registry of models: versions, promotions, what a reader sees."""

from netweave.operators import models
from netweave.session import work_path

LOG = "id long, model_version string, accuracy double, f1_score double, trained_us long"


def test_the_model_in_use_follows_the_notes(spark):
    path = work_path(spark, "test-models")
    logs = spark.createDataFrame([(1, "v1", 0.99, 0.98, 10), (2, "v2", 0.90, 0.99, 20), (3, "v3", None, 0.99, 30)], LOG)
    models.register(models.versions_of(logs), path)
    known = models.versions(spark, path)
    assert models.in_use(spark, path).count() == 0
    assert [r.version for r in models.passing(known).collect()] == ["v1"]
    for wanted, seen in ((2, "v2"), (3, "v3"), (1, "v1"), (99, None)):
        models.promote(spark, path, known.where(f"id = {wanted}"))
        # A version that isn't there leaves no note.
        assert [r.version for r in models.in_use(spark, path).collect()] == [seen or "v1"]
    models.register(models.versions_of(spark.createDataFrame([(4, "v4", 1.0, 1.0, 40)], LOG)), path)
    models.promote(spark, path, models.versions(spark, path).where("id = 4"))
    info = models.model_info(models.in_use(spark, path)).first()
    assert (info.version, info.classes_count, info.features_count, info.deduplication_window) == ("v4", 4, 25, 60)
    assert [r.note for r in models.notes(spark, path).orderBy("note").collect()] == [1, 2, 3, 4]


def test_status_without_a_model(spark):
    path = work_path(spark, "test-models")
    models.register(models.versions_of(spark.createDataFrame([], LOG)), path)
    funnel = spark.createDataFrame([(5, 2)], "total_predictions long, alerts_created long")
    row = models.model_status(models.in_use(spark, path), funnel).first()
    assert tuple(row) == (False, None, 5, 2)
