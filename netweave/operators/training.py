"""Classifiers: fitting, importances, grid search, scoring, saving."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.constants import (
    BOOSTING, CLASS_WEIGHTS, CLASSES, SPLIT_SEED, TUNING_FOLDS, TUNING_GRID,
)
from netweave.functions.scalars import col_of
from netweave.operators.boosting import BINS, BoostedClassifier, Booster, Fit, boost, boosting_rows, tallies
from netweave.operators.clean import scorable_rows
from netweave.operators.prep import feature_vector, fit_scaler, ranked, with_weight
from netweave.session import discard, pinned, written


def scaling_stage(features: list[str], scaler: dict[str, tuple[float, float]]) -> PipelineModel:
    """Scale the features and put them into one vector, keeping all other columns."""
    parts = ", ".join(
        f"(cast(`{c}` as double) - {scaler[c][0]!r}D) / {scaler[c][1]!r}D AS `_z{i}`" for i, c in enumerate(features)
    )
    scale = SQLTransformer(statement=f"SELECT *, {parts} FROM __THIS__")
    gather = VectorAssembler(inputCols=[f"_z{i}" for i in range(len(features))], outputCol="features")
    drop = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(f'`_z{i}`' for i in range(len(features)))}) FROM __THIS__")
    return PipelineModel(stages=[scale, gather, drop])


@dataclass
class Classifier:
    """A fitted forest with its scaling."""

    kind: str
    features: list[str]
    prepare: PipelineModel
    members: list
    label_ids: list[int]
    classes: list[str] = field(default_factory=lambda: list(CLASSES))

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``probabilities``, ``attack_type`` and ``confidence``; ties go to the first class."""
        ready = self.prepare.transform(df)
        out = self.members[0].transform(ready)
        # A filter behind goes not past an explode, so that the forest is asked once per row.
        out = out.withColumn("probabilities", F.explode(F.array(vector_to_array("probability")))).drop(
            "rawPrediction", "probability", "prediction"
        )
        best = F.array_max("probabilities")
        names = F.array(*[F.lit(self.classes[i]) for i in self.label_ids])
        return out.withColumns({
            "confidence": best,
            "attack_type": F.element_at(names, F.array_position("probabilities", best).cast("int")),
        }).drop("features")

    def score_valid(self, df: DataFrame) -> DataFrame:
        """Score the rows whose features are all finite."""
        return self.score(scorable_rows(df, self.features))

    def info(self) -> dict:
        return {"kind": self.kind, "features": self.features, "n_features": len(self.features),
                "classes": self.classes, "label_ids": self.label_ids}

    def save(self, spark: SparkSession, path: str) -> None:
        self.prepare.write().overwrite().save(f"{path}/prepare")
        for i, member in enumerate(self.members):
            member.write().overwrite().save(f"{path}/member-{i}")
        spark.createDataFrame([(json.dumps(self.info()),)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/info")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Classifier | BoostedClassifier:
        """The classifier saved at ``path``, of whichever kind."""
        info = json.loads(spark.read.text(f"{path}/info").first()[0])
        if info["kind"] == "boosted":
            return BoostedClassifier.load(spark, path)
        return Classifier(
            info["kind"], info["features"], PipelineModel.load(f"{path}/prepare"),
            [RandomForestClassificationModel.load(f"{path}/member-0")], info["label_ids"], info["classes"],
        )


@dataclass
class FixedRule:
    """A scorer that needs no fitting: the class is an expression, the confidence a constant."""

    attack_type: Column
    confidence: float = 0.9

    def score_valid(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"attack_type": self.attack_type, "confidence": F.lit(self.confidence)})


def _present(df: DataFrame) -> list[int]:
    """The class ids that occur; at most one row per class."""
    return sorted(r[0] for r in df.select("label_id").distinct().collect())


def bounded(df: DataFrame, columns: list[str], most: int | None) -> DataFrame:
    """About ``most`` rows, chosen by a hash of the columns; all rows if there are fewer or ``most`` is None.

    No registered query asks for fewer than all.
    """
    if most is None:
        return df
    share = min(1.0, most / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))


def _numbered(ids: list[int]) -> Column:
    """0, 1, .. for the class ids that occur."""
    return F.element_at(F.create_map(*[F.lit(v) for p in enumerate(ids) for v in reversed(p)]), F.col("label_id"))


def train(df: DataFrame, features: list[str], kind: str = "forest", rounds: int = BOOSTING["rounds"],
          depth: int = BOOSTING["max_depth"], rate: float = BOOSTING["learning_rate"],
          subsample: float = BOOSTING["subsample"], part: str | None = "part",
          columns: float = BOOSTING["column_sample"], weights: dict[int, float] = CLASS_WEIGHTS,
          fit_rows: int | None = None, seed: int = SPLIT_SEED, patience: int | None = BOOSTING["patience"]) -> Classifier | BoostedClassifier:
    """Fit on the rows of ``part`` = train.

    Boosting stops after ``patience`` rounds without a lower loss on the validation rows and
    keeps the rounds up to the lowest. ``fit_rows`` bounds the labelled rows of the fit.
    """
    fitting = df.where(F.col(part) == "train") if part else df
    ids = _present(fitting)
    usable = bounded(df.where(F.col(part).isin("train", "validation")) if part else df, features, fit_rows)
    held = F.col(part) == "validation" if part else F.lit(False)
    if kind == "boosted":
        known = with_weight(usable.where(F.col("label_id").isin(ids)), weights)
        rows, files = written(boosting_rows(known, features, _numbered(ids), F.col("weight"), held), "fit-rows")
        fit = Fit(1, depth, rate, subsample, columns, BOOSTING["gamma"], BOOSTING["alpha"], BOOSTING["ridge"])
        booster = Booster(rows, features, [fit], len(ids), seed=seed)
        boost(booster, rounds, patience if part else None)
        booster.close()
        discard(df.sparkSession, files)
        grown = booster.grown[0]
        return BoostedClassifier(features, booster.thresholds(0, grown.best()), ids, grown.losses)
    prepare = scaling_stage(features, fit_scaler(fitting, features))
    rows = with_weight(prepare.transform(usable), weights).select(
        "features", "weight", _numbered(ids).cast("double").alias("target"), held.alias("held"))
    # Fitting reads its rows some times over; they are prepared once.
    rows, files = written(rows.where(~F.col("held")).drop("held"), "fit-rows")
    model = RandomForestClassifier(
        featuresCol="features", labelCol="target", weightCol="weight", numTrees=rounds,
        maxDepth=depth, subsamplingRate=subsample, seed=seed,
    ).fit(rows)
    discard(df.sparkSession, files)
    return Classifier(kind, features, prepare, [model], ids)


def _scores(spark: SparkSession, features: list[str], values) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double")


def forest_importance(df: DataFrame, features: list[str], trees: int = 100, depth: int = 5,
                      fit_rows: int | None = None, seed: int = SPLIT_SEED) -> DataFrame:
    """Importances of a random forest with classes weighted to equal shares."""
    df = bounded(df, features, fit_rows)
    counts = {r[0]: r[1] for r in df.groupBy("label_id").count().collect()}
    total = sum(counts.values())
    balanced = {c: total / (len(counts) * n) for c, n in counts.items()}
    rows = with_weight(feature_vector(df, features), balanced).select(
        "features", "weight", F.col("label_id").cast("double").alias("target")
    )
    model = RandomForestClassifier(featuresCol="features", labelCol="target", weightCol="weight",
                                   numTrees=trees, maxDepth=depth, seed=seed).fit(pinned(rows, "fit-rows"))
    return _scores(df.sparkSession, features, model.featureImportances.toArray())


def boosted_importance(df: DataFrame, features: list[str], rounds: int = 100,
                       depth: int = BOOSTING["max_depth"], seed: int = SPLIT_SEED,
                       weights: dict[int, float] = CLASS_WEIGHTS, fit_rows: int | None = None) -> DataFrame:
    """Mean gain per split of a boosted model of all rows, as shares of one; works with classes absent."""
    model = train(df, features, "boosted", rounds, depth, part=None, weights=weights, fit_rows=fit_rows, seed=seed)
    return _scores(df.sparkSession, features, model.importances())


def with_fold(df: DataFrame, key: str, label: str = "label_id", folds: int = TUNING_FOLDS) -> DataFrame:
    """A fold per row; every class is spread evenly to one row, in the order of its hashed shuffle keys."""
    hashed = df.withColumn("_hash", F.xxhash64(F.lit(SPLIT_SEED), F.col(key)))
    placed = ranked(hashed, [label, "_hash", key])
    return placed.withColumn("fold", F.pmod("_rank", F.lit(folds)).cast("int")).drop("_hash", "_rank")


def weighted_f1(matrix: np.ndarray) -> float:
    """F1 of each class weighted by its rows; a class that is never hit has 0. Rows are the truth."""
    hit, truth, taken = np.diag(matrix), matrix.sum(axis=1), matrix.sum(axis=0)
    each = np.divide(2.0 * hit, truth + taken, out=np.zeros(len(hit)), where=truth + taken > 0)
    return float((each * truth).sum() / truth.sum())


def grid_search(df: DataFrame, features: list[str], key: str, grid: dict[str, list] = TUNING_GRID,
                folds: int = TUNING_FOLDS, weights: dict[int, float] = CLASS_WEIGHTS, fit_rows: int | None = None,
                seed: int = SPLIT_SEED, bins: int = BINS, halve_at: tuple[int, ...] = ()) -> DataFrame:
    """Weighted F1 of every combination over the folds; ``is_best`` marks the first of the best.

    All combinations and folds are boosted together, and those that differ in ``n_estimators`` alone are one
    fit looked at after as many rounds. ``fit_rows`` bounds the labelled rows. After each number of rounds in
    ``halve_at`` only the better half of the fits goes on; the others keep the F1 they had, ``rounds``
    tells after how many, and none of them is the best.
    """
    usable = bounded(df.select(*[col_of(c) for c in dict.fromkeys([*features, key, "label_id"])]), features, fit_rows)
    if fit_rows is not None:
        # So that the whole table is worked out twice, for the count and the choice, and not for every pass.
        usable = pinned(usable, "bounded-rows")
    ids = _present(usable)
    rows = with_fold(with_weight(usable, weights), key, folds=folds)
    rows, files = written(boosting_rows(rows, features, _numbered(ids), F.col("weight"), F.col("fold")), "fit-rows")
    others = [n for n in grid if n != "n_estimators"]
    chosen = [dict(zip(others, values)) for values in product(*[grid[n] for n in others])]
    fits = [
        Fit(fold, c["max_depth"], c["learning_rate"], c["subsample"], c["colsample_bytree"]) for c in chosen for fold in range(folds)]

    def mean_f1(matrices: list[np.ndarray]) -> float:
        scores = [weighted_f1(matrix) for matrix in matrices if matrix.sum()]
        return sum(scores) / len(scores)

    reached = {}
    if halve_at:
        booster = Booster(rows, features, fits, len(ids), bins, seed=seed, kept=False)
        live = list(range(len(chosen)))
        for stop in sorted({*grid["n_estimators"], *halve_at}):
            models = [i * folds + fold for i in live for fold in range(folds)]
            boost(booster, stop, None, models)
            matrices = booster.tally(models)
            for i in live:
                reached[i, stop] = mean_f1([matrices[i * folds + fold] for fold in range(folds)])
            if stop in halve_at:
                live = sorted(sorted(live, key=lambda i: (-reached[i, stop], i))[:-(-len(live) // 2)])
        booster.close()
    else:
        matrices = tallies(rows, features, fits, len(ids), sorted(set(grid["n_estimators"])), bins, seed)
        for i in range(len(chosen)):
            for stop in grid["n_estimators"]:
                reached[i, stop] = mean_f1([matrices[i * folds + fold, stop] for fold in range(folds)])
    discard(df.sparkSession, files)
    table = []
    for values in product(*grid.values()):
        one = dict(zip(grid, values))
        i = chosen.index({n: one[n] for n in others})
        stop = max(s for j, s in reached if j == i and s <= one["n_estimators"])
        table.append((json.dumps(one), reached[i, stop], stop, stop == one["n_estimators"]))
    best = max((k for k in range(len(table)) if table[k][3]), key=lambda k: (table[k][1], -k))
    marked = [(parameters, score, stop, k == best) for k, (parameters, score, stop, _) in enumerate(table)]
    return df.sparkSession.createDataFrame(marked, "parameters string, mean_f1 double, rounds int, is_best boolean")


def combinations(grid: dict[str, list] = TUNING_GRID) -> int:
    return len(list(product(*grid.values())))
