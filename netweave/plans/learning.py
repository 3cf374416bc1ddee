"""Queries over labelled flows: feature scores, classifiers, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netweave.constants import BOOSTING, CLASS_WEIGHTS, CLASSES, METHOD_WEIGHTS, TUNING_GRID
from netweave.operators import boosting, clean, evaluation, prep, selection, training
from netweave.plans.cleaning import CLEAN, SPLIT, cleaned, split, split_ends
from netweave.plans.registry import query
from netweave.session import prepared, remembered, work_path
from netweave.sources import documents, views
from netweave.sources.views import FLOW_KEYS, FLOW_NUMERIC, LEARNABLE, PREDICTIONS

CLASS_ROWS = "(values " + ", ".join(f"('{c}')" for c in CLASSES) + ")"

MATRIX = f"""
matrix as (
 select t.c truth, p.c predicted, coalesce(k.n, 0) n
 from {CLASS_ROWS} t(c) cross join {CLASS_ROWS} p(c)
 left join (select truth, predicted, count(*) n from ({PREDICTIONS}) r group by 1, 2) k
  on k.truth = t.c and k.predicted = p.c),
errors as (
 select c class_name,
  cast((select sum(n) from matrix where truth = c and predicted = c) as bigint) tp,
  cast((select sum(n) from matrix where truth <> c and predicted = c) as bigint) fp,
  cast((select sum(n) from matrix where truth = c and predicted <> c) as bigint) fn,
  cast((select sum(n) from matrix where truth <> c and predicted <> c) as bigint) tn
 from {CLASS_ROWS} v(c)),
scores as (
 select *, tp + fn support, tp / (tp + fp) "precision", tp / (tp + fn) recall,
  2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) f1_score, fp / (fp + tn) fpr
 from errors)"""

REPORT = f"""
{MATRIX},
report as (
 select class_name, "precision", recall, f1_score, support from scores
 union all select 'accuracy', null, null, sum(tp) / sum(support), cast(sum(support) as bigint) from scores
 union all select 'macro avg', avg("precision"), avg(recall), avg(f1_score), cast(sum(support) as bigint) from scores
 union all select 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1_score * support) / sum(support), cast(sum(support) as bigint) from scores)"""


def matrix(spark, folder):
    return evaluation.confusion_matrix(views.predictions(spark, folder))


@query("confusion_matrix", f"""
with {MATRIX} select truth, predicted, n, round(n * 100.0::double / sum(n) over (partition by truth), 4) row_pct from matrix""")
def confusion_matrix(spark, folder):
    return matrix(spark, folder)


@query("class_fpr", f"""
with {MATRIX} select class_name, tp true_positives, fp false_positives, tn true_negatives, fn false_negatives,
 round(fpr, 9) false_positive_rate from scores""")
def class_fpr(spark, folder):
    found = evaluation.class_errors(matrix(spark, folder))
    return found.drop("support", "total").withColumn("false_positive_rate", F.round("false_positive_rate", 9))


@query("classification_report", f"""
with {REPORT} select class_name, round("precision", 9) "precision", round(recall, 9) recall,
 round(f1_score, 9) f1_score, support from report""")
def classification_report(spark, folder):
    found = evaluation.classification_report(matrix(spark, folder))
    return found.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1_score")})


@query("quality_gate", f"""
with {REPORT},
gates as (
 select 'accuracy' metric, f1_score v, 0.95::double gate_limit, f1_score >= 0.95 passed from report where class_name = 'accuracy'
 union all select 'f1_score', f1_score, 0.90::double, f1_score >= 0.90 from report where class_name = 'weighted avg'
 union all select 'false_positive_rate', max(fpr), 0.05::double, max(fpr) <= 0.05 from scores)
select metric, round(v, 6) value, gate_limit, passed from gates""")
def quality_gate(spark, folder):
    return evaluation.quality_gates(matrix(spark, folder))


FLAT = f"""
with {REPORT}
select class_name, metric, round(value, 9) value from (
 select class_name, 'precision' metric, "precision" value from report where class_name <> 'accuracy'
 union all select class_name, 'recall', recall from report where class_name <> 'accuracy'
 union all select class_name, 'f1-score', f1_score from report where class_name <> 'accuracy'
 union all select class_name, 'support', cast(support as double) from report where class_name <> 'accuracy'
 union all select class_name, 'accuracy', f1_score from report where class_name = 'accuracy') x"""


@query("metrics_flatten", f"""
select 'test' split, t.* from ({FLAT}) t
union all select 'validation', v.* from ({FLAT.replace(f'({PREDICTIONS})', f'(select * from ({PREDICTIONS}) y where flow_no % 3 = 0)')}) v""")
def metrics_flatten(spark, folder):
    """The metrics of two splits as one nested JSON document, written, read back and flattened."""
    path = work_path(spark, "metrics")
    third = evaluation.confusion_matrix(views.predictions(spark, folder).where("flow_no % 3 = 0"))
    documents.write_metrics({
        "test": evaluation.metrics_document(matrix(spark, folder)),
        "validation": evaluation.metrics_document(third),
    }, path)
    found = evaluation.flatten_metrics(documents.read_metrics(spark, path))
    return found.withColumn("value", F.round("value", 9))


# --- feature scores ----------------------------------------------------------

PAIRS = f"with cleaned as materialized (select * from {CLEAN} c), pairs as (" + "\nunion all\n".join(
    f"select '{b}' feature1, '{a}' feature2, abs(corr({a}, {b})) correlation from cleaned"
    for i, a in enumerate(FLOW_NUMERIC) for b in FLOW_NUMERIC[i + 1:]) + ")"

ANOVA = "anova as (" + "\nunion all\n".join(f"""
select '{c}' feature, (sum(n * (mean - grand) * (mean - grand)) / (count(*) - 1)) / (sum(n * spread) / (sum(n) - count(*))) f_score
from (select count(*) n, avg({c}) mean, var_pop({c}) spread, sum(sum({c})) over () / sum(count(*)) over () grand
 from cleaned group by label) g""" for c in FLOW_NUMERIC) + ")"

BINS = 20
MUTUAL = f"""
long_form as ({' union all '.join(f"select label, '{c}' feature, cast({c} as double) x from cleaned" for c in FLOW_NUMERIC)}),
cuts as (select feature, quantile_disc(x, [{', '.join(f'{i / BINS:.2f}' for i in range(1, BINS))}]) cut from long_form group by feature),
binned as (
 select feature, label, len(list_filter(list_distinct(cut), lambda c: x > c)) bin
 from long_form join cuts using (feature)),
cells as (select feature, bin, label, count(*) n from binned group by 1, 2, 3),
shares as (
 select *, sum(n) over (partition by feature) al, sum(n) over (partition by feature, bin) b,
  sum(n) over (partition by feature, label) l from cells),
mutual as (
 select feature, sum(n / al * ln((n::double * al::double) / (b::double * l::double))) mi_score from shares group by feature)"""

#: Stand-ins for the two models' importances, so that SQL can check the blend of all four methods.
STAND_INS = {
    "random_forest": {c: (i * 3 % 8 + 1) / 40 for i, c in enumerate(FLOW_NUMERIC)},
    "xgboost": {c: (i * 5 % 8 + 2) / 80 for i, c in enumerate(FLOW_NUMERIC)},
}
METHODS = ["random_forest", "xgboost", "univariate", "mutual_info"]
MODEL_ROWS = ", ".join(f"('{m}', '{c}', {v}::double)" for m, of in STAND_INS.items() for c, v in of.items())

SCORES = f"""
with cleaned as materialized (select * from {CLEAN} c),
{ANOVA},
{MUTUAL},
scores as (select 'univariate' as "method", feature, f_score score from anova
 union all select 'mutual_info', feature, mi_score from mutual
 union all select * from (values {MODEL_ROWS}) t),
ranged as (
 select *, min(score) over (partition by "method") lo, max(score) over (partition by "method") hi from scores),
blended as (
 select feature, {', '.join(f"""sum(case when "method" = '{m}' then (score - lo) / (hi - lo) * {METHOD_WEIGHTS[m]} end) {m}""" for m in METHODS)}
 from ranged group by feature),
ordered as (select *, row_number() over (order by round({' + '.join(METHODS)}, 9) desc, feature) place from blended)"""

#: The forced features among those this table has, in their fixed order.
FORCED = ["flow_duration", "flow_bytes_s", "flow_pkts_s"]
CHOSEN = 5


def scores(spark, folder):
    return prepared(spark, folder, "lineitem", "feature-scores", lambda: computed_scores(spark, folder))


def computed_scores(spark, folder):
    rows = cleaned(spark, folder).select(*FLOW_NUMERIC, "label")
    models = {
        m: spark.createDataFrame(list(of.items()), "feature string, importance double") for m, of in STAND_INS.items()
    }
    return selection.long_scores({
        **models,
        "univariate": selection.anova_f(rows, FLOW_NUMERIC),
        "mutual_info": selection.mutual_information(rows, FLOW_NUMERIC, bins=BINS),
    })


@query("corr_pairs", f"""
{PAIRS} select feature1, feature2, round(correlation, 6) correlation from pairs where correlation > 0.95""")
def corr_pairs(spark, folder):
    found = selection.correlated_pairs(cleaned(spark, folder), FLOW_NUMERIC)
    return found.withColumn("correlation", F.round("correlation", 6))


@query("redundant_features", f"{PAIRS} select distinct feature2 feature from pairs where correlation > 0.95")
def redundant_features(spark, folder):
    return selection.redundant_features(selection.correlated_pairs(cleaned(spark, folder), FLOW_NUMERIC))


@query("anova_f", f"with cleaned as materialized (select * from {CLEAN} c), {ANOVA} select feature, round(f_score, 6) f_score from anova")
def anova_f(spark, folder):
    found = selection.anova_f(cleaned(spark, folder), FLOW_NUMERIC)
    return found.withColumn("f_score", F.round("f_score", 6))


@query("mutual_info", f"""
with cleaned as materialized (select * from {CLEAN} c), {MUTUAL} select feature, round(mi_score, 9) mi_score from mutual""")
def mutual_info(spark, folder):
    rows = cleaned(spark, folder).select(*FLOW_NUMERIC, "label")
    found = selection.mutual_information(rows, FLOW_NUMERIC, bins=BINS)
    return found.withColumn("mi_score", F.round("mi_score", 9))


@query("aggregate_scores", f"""
{SCORES} select feature, {', '.join(f'round({m}, 6) score_{m}' for m in METHODS)}, round({' + '.join(METHODS)}, 6) final_score from blended""")
def aggregate_scores(spark, folder):
    found = selection.blend_scores(scores(spark, folder), METHODS, METHOD_WEIGHTS)
    return found.select("feature", *[F.round(c, 6).alias(c) for c in found.columns if c != "feature"])


@query("select_top_features", f"""
{SCORES},
last as (
 select feature, row_number() over (order by case feature when 'flow_pkts_s' then 3 when 'flow_bytes_s' then 2
  when 'flow_duration' then 1 else 0 end desc, place) rn from ordered where place >= {CHOSEN})
select feature, cast(place as int) "position" from ordered where place < {CHOSEN}
union all select feature, {CHOSEN} from last where rn = 1""")
def select_top_features(spark, folder):
    blended = selection.blend_scores(scores(spark, folder), METHODS)
    return selection.select_top(blended, CHOSEN, FORCED)


@query("feature_list", f"""
{SCORES},
last as (
 select feature, row_number() over (order by case feature when 'flow_pkts_s' then 3 when 'flow_bytes_s' then 2
  when 'flow_duration' then 1 else 0 end desc, place) rn from ordered where place >= {CHOSEN}),
chosen as (
 select feature, place from ordered where place < {CHOSEN} union all select feature, {CHOSEN} from last where rn = 1)
select string_agg(feature, ',' order by place) selected_features, count(*) n_features from chosen""")
def feature_list(spark, folder):
    """The chosen features as a JSON record, written and read back."""
    path = work_path(spark, "feature-list")
    blended = selection.blend_scores(scores(spark, folder), METHODS)
    documents.write_json(documents.feature_list(selection.select_top(blended, CHOSEN, FORCED)), path)
    found = spark.read.schema("selected_features array<string>, n_features bigint").json(path)
    return found.withColumn("selected_features", F.array_join("selected_features", ","))


@query("feature_mapping", f"""
{SCORES},
last as (
 select feature, row_number() over (order by case feature when 'flow_pkts_s' then 3 when 'flow_bytes_s' then 2
  when 'flow_duration' then 1 else 0 end desc, place) rn from ordered where place >= {CHOSEN}),
chosen as (
 select feature, place from ordered where place < {CHOSEN} union all select feature, {CHOSEN} from last where rn = 1)
select feature, cast(place - 1 as int) feature_index from chosen""")
def feature_mapping(spark, folder):
    """The index of each chosen feature as a JSON record, written and read back."""
    path = work_path(spark, "feature-mapping")
    blended = selection.blend_scores(scores(spark, folder), METHODS)
    documents.write_json(documents.feature_mapping(selection.select_top(blended, CHOSEN, FORCED)), path)
    found = spark.read.schema("selected_features array<string>, feature_indices map<string, int>").json(path)
    return found.select(F.explode("feature_indices").alias("feature", "feature_index"))


@query("score_table", f"{SCORES} select \"method\", feature, round(score, 6) score from scores")
def score_table(spark, folder):
    """Feature scores as a CSV table, written and read back."""
    path = work_path(spark, "scores")
    documents.write_scores(scores(spark, folder), path)
    found = spark.read.schema("method string, feature string, score double").option("header", True).csv(path)
    return found.withColumn("score", F.round("score", 6))


@query("method_matrix", f"""
{SCORES}
select feature, {', '.join(f"""round(max(case when "method" = '{m}' then case when hi > 0 then score / hi else 0 end end), 6) {m}""" for m in METHODS)}
from ranged where feature in (select feature from ordered where place <= {CHOSEN}) group by feature""")
def method_matrix(spark, folder):
    long = scores(spark, folder)
    found = selection.method_matrix(long, selection.blend_scores(long, METHODS), METHODS, CHOSEN)
    return found.select("feature", *[F.round(m, 6).alias(m) for m in METHODS])


# --- classifiers -----------------------------------------------------------------

#: The labelled rows that the grid search takes: all of them.
GRID_ROWS = None
TREES = 100


def learnable(spark, folder):
    """The cleaned flows with the label that can be learned; read and cleaned anew, never written."""
    raw = views.learnable_flows(spark, folder)
    known = remembered(spark, folder, "lineitem", "learnable-flows", lambda: clean.repairs(raw))
    return prep.encode_labels(clean.clean(raw, known=known))


@query("rf_importance")
def rf_importance(spark, folder):
    found = training.forest_importance(learnable(spark, folder), FLOW_NUMERIC, TREES)
    return found.withColumn("importance", F.round("importance", 6))


@query("gbt_importance")
def gbt_importance(spark, folder):
    found = training.boosted_importance(learnable(spark, folder), FLOW_NUMERIC)
    return found.withColumn("importance", F.round("importance", 6))


def trained_rows(spark, folder):
    """The learnable flows with their part."""
    flows = learnable(spark, folder)
    return split(flows, prepared(spark, folder, "lineitem", "learnable-ends", lambda: split_ends(flows)))


def trained(spark, folder, kind="forest"):
    """The split rows and a classifier, fitted once per session, folder and kind."""
    rows = trained_rows(spark, folder)
    rounds = TREES if kind == "forest" else BOOSTING["rounds"]
    return rows, remembered(
        spark, folder, "lineitem", f"{kind}-model", lambda: training.train(rows, FLOW_NUMERIC, kind, rounds=rounds))


def tested(rows, model):
    scored = model.score(rows.where(F.col("part") == "test"))
    return evaluation.confusion_matrix(scored, "label", "attack_type")


@query("train_classifier")
def train_classifier(spark, folder):
    """A forest on the training part; its report on the test part."""
    found = evaluation.classification_report(tested(*trained(spark, folder)))
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1_score")})


@query("train_boosted")
def train_boosted(spark, folder):
    """One boosted model of all classes, stopped early on the validation part."""
    found = evaluation.classification_report(tested(*trained(spark, folder, "boosted")))
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1_score")})


LEARNT = SPLIT % f"({LEARNABLE})"


@query("train_supports", f"""
select label class_name, count(*) support from {LEARNT} s where part = 'test' group by label""")
def train_supports(spark, folder):
    """Rows per class that the classifiers are tested on."""
    found = evaluation.class_errors(tested(*trained(spark, folder)))
    return found.select("class_name", "support")


@query("train_gates", f"""
select m.c metric, (select count(*) from {LEARNT} s where part = 'test') > 0 passed
from (values ('accuracy'), ('f1_score')) m(c)""")
def train_gates(spark, folder):
    """Whether the classifier passes the gates on accuracy and F1 on the test part."""
    found = evaluation.quality_gates(tested(*trained(spark, folder)))
    return found.where("metric <> 'false_positive_rate'").select("metric", "passed")


@query("score_check", f"""
select count(*) scored, count(*) known_class, count(*) sure_enough, count(*) sums_to_one from ({LEARNABLE}) r""")
def score_check(spark, folder):
    """All flows scored: rows with a known class, a possible confidence, and shares that sum to one."""
    rows, model = trained(spark, folder)
    total = F.aggregate("probabilities", F.lit(0.0), lambda acc, p: acc + p)
    best = F.get("probabilities", F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1)
    return model.score_valid(rows).agg(
        F.count("*").alias("scored"), F.count_if(F.col("attack_type").isin(CLASSES)).alias("known_class"),
        F.count_if((F.col("confidence") >= 1 / len(model.label_ids)) & (F.col("confidence") <= 1) & (F.col("confidence") == best)).alias("sure_enough"),
        F.count_if(F.abs(total - 1) < 1e-9).alias("sums_to_one"))


@query("score_flows")
def score_flows(spark, folder):
    """All flows scored by a classifier that was saved and loaded again."""
    rows, model = trained(spark, folder)
    path = work_path(spark, "classifier")
    model.save(spark, path)
    found = training.Classifier.load(spark, path).score_valid(rows)
    return found.select(*FLOW_KEYS, "attack_type", F.round("confidence", 6).alias("confidence"))


def grid_scores(spark, folder):
    """All declared combinations of boosted trees over stratified folds, searched once per session."""
    return prepared(spark, folder, "lineitem", "grid-scores", lambda: training.grid_search(
        learnable(spark, folder), FLOW_NUMERIC, "shuffle_key", fit_rows=GRID_ROWS))


@query("grid_search")
def grid_search(spark, folder):
    return grid_scores(spark, folder).withColumn("mean_f1", F.round("mean_f1", 6))


GRID = "n_estimators int, max_depth int, learning_rate double, subsample double, colsample_bytree double"


@query("grid_check", f"""
select cast(a as int) n_estimators, cast(b as int) max_depth, c::double learning_rate, d::double subsample, e::double colsample_bytree,
 (select count(*) from {LEARNT} s) > 0 better_than_guessing, cast(1 as bigint) best_of_all
from (values {', '.join(f'({v})' for v in TUNING_GRID['n_estimators'])}) n(a), (values {', '.join(f'({v})' for v in TUNING_GRID['max_depth'])}) m(b),
 (values {', '.join(f'({v})' for v in TUNING_GRID['learning_rate'])}) l(c), (values {', '.join(f'({v})' for v in TUNING_GRID['subsample'])}) u(d),
 (values {', '.join(f'({v})' for v in TUNING_GRID['colsample_bytree'])}) p(e)""")
def grid_check(spark, folder):
    """The combinations searched, whether each beats always naming the most frequent class, and how many are the best."""
    found = grid_scores(spark, folder)
    counts = learnable(spark, folder).groupBy("label").count()
    share = counts.agg((F.max("count") / F.sum("count")).alias("_share"))
    told = found.join(F.broadcast(share), F.lit(True)).select(
        F.from_json("parameters", GRID).alias("p"), (F.col("mean_f1") > 2 * F.col("_share") ** 2 / (1 + F.col("_share"))).alias("better_than_guessing"),
        F.sum(F.col("is_best").cast("long")).over(Window.partitionBy()).alias("best_of_all"))
    return told.select("p.*", "better_than_guessing", "best_of_all")


#: Rows as cleaned, with the label that can be learned; gradients and hessians of a round in which all classes are alike.
FIRST = f"""
with ready as materialized (
 select c.* exclude (label), case when shuffle_key % 200 = 0 then label when fwd_bytes > 60000 then 'DDoS' when fwd_pkts < 8 then 'PortScan'
  when avg_fwd_size > 2500 then 'DoS Hulk' else 'BENIGN' end label from {CLEAN} c),
long_form as ({' union all '.join(f"select label, {i} f, cast({c} as double) x from ready" for i, c in enumerate(FLOW_NUMERIC))}),
cuts as (select distinct f, unnest(quantile_disc(x, [{', '.join(f'{i / 16:.4f}' for i in range(1, 16))}])) cut from long_form group by f),
counted as (select c.f, c.cut, label, count(*) filter (x <= cut) low, count(*) n from cuts c join long_form l on c.f = l.f group by all),
known as (select * from (values {', '.join(f"({i}, '{c}', {CLASS_WEIGHTS[i]}::double)" for i, c in enumerate(CLASSES))}) t(k, name, w)),
sums as (
 select c.f, c.cut, t.k, sum(low * o.w * (0.25 - case when o.k = t.k then 1 else 0 end)) gl, sum(low * o.w * 0.375) hl,
  sum(n * o.w * (0.25 - case when o.k = t.k then 1 else 0 end)) g, sum(n * o.w * 0.375) h, sum(n) n
 from counted c join known o on o.name = c.label cross join known t group by all),
gains as (
 select *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) gain from sums where hl >= 1 and h - hl >= 1),
ordered as (select *, row_number() over (partition by k order by gain desc, f, cut) place from gains)
select cast(k as int) class_id, cast(f as int) feature_no, cut, round(gain / n, 5) gain_per_row from ordered where place = 1"""


@query("first_splits", FIRST)
def first_splits(spark, folder):
    """The booster's first split per class over all rows: feature, cut and gain."""
    rows = prep.with_weight(learnable(spark, folder))
    ready = boosting.boosting_rows(rows, FLOW_NUMERIC, F.col("label_id"), F.col("weight"), F.lit(0))
    fit = boosting.Fit(held=1, depth=1, subsample=1.0, columns=1.0)
    booster = boosting.Booster(ready, FLOW_NUMERIC, [fit], len(CLASSES), bins=16)
    booster.round([0])
    booster.close()
    found = [
        (c, int(tree["feature"][0]), float(tree["limit"][0]), float(tree["gain"][0]) / booster.rows[0])
        for c, tree in enumerate(booster.thresholds(0)[0])]
    table = spark.createDataFrame(found, "class_id int, feature_no int, cut double, gain_per_row double")
    return table.withColumn("gain_per_row", F.round("gain_per_row", 5))
