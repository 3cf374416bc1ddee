"""Confusion matrix and everything that follows from it.

The rows are counted once; all other figures come from the few cells of the matrix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.constants import CLASSES, QUALITY_GATES
from netweave.functions.scalars import ratio

OTHER = "other"


def confusion_matrix(df: DataFrame, truth: str = "truth", predicted: str = "predicted",
                     classes=CLASSES) -> DataFrame:
    """Every pair of classes, with its rows and its percentage of the true class.

    Null and unknown classes count as the class ``OTHER``, which appears in the matrix, as
    truth and as prediction, if there are any.
    """
    def known(name: str) -> Column:
        return F.when(F.col(name).isin(*classes), F.col(name)).otherwise(F.lit(OTHER))

    counted = df.groupBy(known(truth).alias("truth"), known(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # At most a row for each pair of classes.
    names = F.array(*[F.lit(c) for c in classes])
    odd = counted.agg(F.coalesce(F.max((F.col("truth") == OTHER) | (F.col("predicted") == OTHER)), F.lit(False)).alias("odd"))
    one = odd.select(F.when(F.col("odd"), F.array_append(names, OTHER)).otherwise(names).alias("names"))
    grid = one.select("names", F.explode("names").alias("truth")).select("truth", F.explode("names").alias("predicted"))
    filled = grid.join(F.broadcast(counted), ["truth", "predicted"], "left").select(
        "truth", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )
    of_truth = F.sum("n").over(Window.partitionBy("truth"))
    return filled.withColumn("row_pct", F.round(ratio(F.col("n") * 100.0, of_truth), 4))


def class_errors(matrix: DataFrame) -> DataFrame:
    """Per class: true and false positives and negatives, and the false positive rate."""
    hit = F.col("truth") == F.col("predicted")
    sides = matrix.select(
        F.explode(F.array(
            F.struct(F.col("truth").alias("class_name"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("called")),
            F.struct(F.col("predicted").alias("class_name"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("called")),
        )).alias("s"),
        F.when(hit, F.col("n")).otherwise(0).alias("hits"),
    )
    sums = sides.groupBy("s.class_name").agg(
        F.sum("s.actual").alias("support"),
        F.sum("s.called").alias("called"),
        # Every hit was listed on both sides.
        (F.sum("hits") / 2).cast("long").alias("true_positives"),
    )
    total = F.sum("support").over(Window.partitionBy(F.lit(1)))
    fp, fn = F.col("called") - F.col("true_positives"), F.col("support") - F.col("true_positives")
    return sums.withColumn("total", total).select(
        "class_name", "true_positives",
        fp.alias("false_positives"),
        (F.col("total") - F.col("support") - fp).alias("true_negatives"),
        fn.alias("false_negatives"),
        "support", "total",
    ).withColumn(
        "false_positive_rate",
        ratio(F.col("false_positives"), F.col("false_positives") + F.col("true_negatives")),
    )


def _class_scores(errors: DataFrame) -> DataFrame:
    tp = F.col("true_positives")
    scored = errors.withColumns({
        "precision": ratio(tp, tp + F.col("false_positives")),
        "recall": ratio(tp, tp + F.col("false_negatives")),
    })
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1_score", ratio(2 * p * r, p + r))


def classification_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and both averages.

    The accuracy row holds the accuracy under ``f1_score``.
    """
    scored = _class_scores(class_errors(matrix))
    figures = ["precision", "recall", "f1_score"]
    support = F.sum("support")
    rows = scored.agg(F.array(
        F.struct(
            F.lit("accuracy").alias("class_name"),
            F.lit(None).cast("double").alias("precision"),
            F.lit(None).cast("double").alias("recall"),
            (F.sum("true_positives") / support).alias("f1_score"),
            support.alias("support"),
        ),
        F.struct(F.lit("macro avg").alias("class_name"), *[F.avg(c).alias(c) for c in figures],
                 support.alias("support")),
        F.struct(F.lit("weighted avg").alias("class_name"),
                 *[(F.sum(F.col(c) * F.col("support")) / support).alias(c) for c in figures],
                 support.alias("support")),
    ).alias("_rows")).select(F.inline("_rows"))
    return scored.select("class_name", *figures, "support").unionByName(rows)


def quality_gates(matrix: DataFrame, gates: dict[str, float] = QUALITY_GATES) -> DataFrame:
    """Accuracy, weighted F1 and the worst false positive rate against their limits."""
    scored = _class_scores(class_errors(matrix))
    support = F.sum("support")
    fpr = F.max("false_positive_rate")
    accuracy = F.sum("true_positives") / support
    f1 = F.sum(F.col("f1_score") * F.col("support")) / support
    rows = [("accuracy", accuracy, gates["min_accuracy"], True),
            ("f1_score", f1, gates["min_f1_score"], True),
            ("false_positive_rate", fpr, gates["max_false_positive_rate"], False)]
    return scored.agg(F.array(*[
        F.struct(
            F.lit(name).alias("metric"), F.round(value, 6).alias("value"), F.lit(limit).alias("gate_limit"),
            ((value >= limit) if at_least else (value <= limit)).alias("passed"),
        )
        for name, value, limit, at_least in rows
    ]).alias("_rows")).select(F.inline("_rows"))


def metrics_document(matrix: DataFrame) -> DataFrame:
    """One nested record: overall figures, report per class, matrix as rows of counts."""
    report = classification_report(matrix)
    entry = F.struct("precision", "recall", F.col("f1_score").alias("f1-score"),
                     F.col("support").cast("double").alias("support"))
    weighted = F.col("class_name") == "weighted avg"
    order = F.array(*[F.lit(c) for c in [*CLASSES, OTHER]])
    position = F.array_position(order, F.col("predicted"))
    lines = matrix.groupBy("truth").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(position.alias("p"), "n"))), lambda s: s["n"]).alias("line")
    )
    truth_at = F.array_position(order, F.col("truth"))
    table = lines.agg(
        F.transform(F.sort_array(F.collect_list(F.struct(truth_at.alias("p"), "line"))), lambda s: s["line"]).alias("confusion_matrix")
    )
    named = [*CLASSES, OTHER, "macro avg", "weighted avg"]
    accuracy = F.max(F.when(F.col("class_name") == "accuracy", F.col("f1_score")))
    entries = [F.max(F.when(F.col("class_name") == c, entry)).alias(c) for c in named]
    figures = report.agg(
        accuracy.alias("accuracy"),
        *[F.max(F.when(weighted, F.col(c))).alias(c) for c in ("precision", "recall", "f1_score")],
        F.struct(*entries, accuracy.alias("accuracy")).alias("classification_report"),
    )
    # Both sides are one row.
    return figures.join(F.broadcast(table), F.lit(True))


def flatten_metrics(document: DataFrame) -> DataFrame:
    """Documents as read back, as rows of split, class, metric and value.

    An entry that is a number is the metric of its own name.
    """
    entries = document.select("split", F.explode("classification_report").alias("class_name", "told"))
    names = ("precision", "recall", "f1-score", "support")
    told = F.from_json("told", ", ".join(f"`{m}` double" for m in names))
    figures = F.array(*[F.struct(F.lit(m).alias("metric"), told[m].alias("value")) for m in names])
    single = F.array(F.struct(F.col("class_name").alias("metric"), F.expr("try_cast(told as double)").alias("value")))
    is_object = F.ltrim("told").startswith("{")
    return entries.select("split", "class_name", F.inline(F.when(is_object, figures).otherwise(single))).where(
        F.col("value").isNotNull())
