"""The booster against a plain walk over rows, nodes and cuts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweave.operators import boosting, training
from netweave.operators.boosting import Booster, Fit

CUTS = {"a": [1.0, 2.0, 3.5], "b": [0.0, 5.0], "c": [10.0, 20.0, 30.0, 40.0]}


def sample(n=240, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 5, n).astype(float), rng.normal(3, 4, n).round(2), rng.integers(0, 50, n).astype(float)
    target = np.where(a > 2, np.where(b > 3, 0, 1), np.where(c > 25, 2, 1))
    target = np.where(rng.random(n) < 0.1, rng.integers(0, 3, n), target)
    return [(int(t), float(w), int(h), int(d), float(x), float(y), float(z)) for t, w, h, d, x, y, z in zip(
        target, rng.choice([1.0, 2.5], n), rng.integers(0, 3, n), rng.integers(-2**62, 2**62, n), a, b, c)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "target int, weight double, held int, draw long, a double, b double, c double")


def plain(rows, fit, rounds, classes=3, seed=42):
    """Margins of all rows after each round, by recursion over single rows."""
    names, margins, out = list(CUTS), [[0.0] * classes for _ in rows], []
    shrunk = lambda g: math.copysign(max(abs(g) - fit.alpha, 0.0), g)
    for number in range(rounds):
        seen = boosting.drawn_rows(np.array([r[3] for r in rows]), fit.subsample, number, seed)
        shares = [[math.exp(m) / sum(map(math.exp, ms)) for m in ms] for ms in margins]
        moves = [[0.0] * classes for _ in rows]
        for c in range(classes):
            columns = boosting.drawn_columns(len(names), fit.columns, number, c, seed)
            slope = {i: (r[1] * (shares[i][c] - (r[0] == c)), 2 * r[1] * shares[i][c] * (1 - shares[i][c])) for i, r in enumerate(rows)}

            def grow(everyone, depth, c=c, columns=columns, slope=slope, seen=seen, moves=moves):
                mine = [i for i in everyone if seen[i] and rows[i][2] != fit.held]
                total = [sum(slope[i][k] for i in mine) for k in (0, 1)]
                best = (max(fit.gamma, 1e-9), None)
                for f in columns if depth < fit.depth else []:
                    for cut in CUTS[names[f]]:
                        left = [i for i in mine if rows[i][4 + f] <= cut]
                        g, h = (sum(slope[i][k] for i in left) for k in (0, 1))
                        sides = ((g, h), (total[0] - g, total[1] - h))
                        if min(s[1] for s in sides) < fit.child_weight:
                            continue
                        gain = sum(shrunk(a) ** 2 / (b + fit.ridge) for a, b in sides) - shrunk(total[0]) ** 2 / (total[1] + fit.ridge)
                        if gain > best[0] + 1e-6:
                            best = (gain, (f, cut))
                if best[1] is None:
                    if depth:
                        for i in everyone:
                            moves[i][c] = -fit.rate * shrunk(total[0]) / (total[1] + fit.ridge)
                    return
                f, cut = best[1]
                grow([i for i in everyone if rows[i][4 + f] <= cut], depth + 1)
                grow([i for i in everyone if rows[i][4 + f] > cut], depth + 1)

            grow(range(len(rows)), 0)
        margins = [[a + b for a, b in zip(m, v)] for m, v in zip(margins, moves)]
        out.append(margins)
    return out


FITS = [Fit(held=1, depth=3, gamma=0.1, alpha=0.1), Fit(held=2, depth=2, rate=0.5, subsample=1.0, columns=1.0), Fit(held=9, depth=4)]


@pytest.mark.parametrize("finish", [0, 30, 1 << 15])
def test_margins_equal_a_plain_walk(spark, finish):
    rows = sample()
    booster = Booster(frame(spark, rows), ["a", "b", "c"], FITS, 3, cuts=CUTS, finish=finish)
    boosting.boost(booster, 3, None)
    values = np.array([[r[4 + f] for r in rows] for f in range(3)])
    for m, fit in enumerate(FITS):
        expected = np.array(plain(rows, fit, 3)[-1]).T
        assert np.allclose(boosting.margins_of(booster.thresholds(m), values), expected, atol=1e-5)
        truth = np.array([r[0] for r in rows])
        out = np.array([r[2] for r in rows]) == fit.held
        matrix = np.zeros((3, 3), int)
        np.add.at(matrix, (truth[out], expected[:, out].argmax(axis=0)), 1)
        assert (booster.tally([m])[m] == matrix).all()
    booster.close()


def test_sums_of_many_parts_are_merged(spark):
    rows = sample()
    whole = Booster(frame(spark, rows), ["a", "b", "c"], FITS, 3, cuts=CUTS, finish=0)
    boosting.boost(whole, 1, None)
    salted = Booster(frame(spark, rows), ["a", "b", "c"], FITS, 3, cuts=CUTS, finish=0)
    salted.wide = True
    boosting.boost(salted, 1, None)
    for a, b in zip(whole.grown, salted.grown):
        assert all((x["feature"] == y["feature"]).all() and (x["value"] == y["value"]).all() for x, y in zip(a.trees[0], b.trees[0]))


def test_losses_and_the_stop(spark):
    rows = sample()
    fit = Fit(held=1, depth=4, rate=0.8, subsample=1.0, columns=1.0, child_weight=0.1)
    booster = Booster(frame(spark, rows), ["a", "b", "c"], [fit], 3, cuts=CUTS)
    boosting.boost(booster, 60, 3)
    losses = booster.grown[0].losses
    margins = [[[0.0] * 3] * len(rows), *plain(rows, fit, len(losses) - 1)]
    for told, after in zip(losses, margins):
        held = [-math.log(math.exp(m[r[0]]) / sum(map(math.exp, m))) for r, m in zip(rows, after) if r[2] == 1]
        assert abs(told - sum(held) / len(held)) < 1e-5
    assert booster.number < 60 and booster.grown[0].best() == booster.number - 3 == int(np.argmin(losses))


def test_grid_agrees_with_single_fits(spark):
    rows = [(i, t, x, y, z) for i, (t, _, _, _, x, y, z) in enumerate(sample(200))]
    df = spark.createDataFrame(rows, "key int, label_id int, a double, b double, c double")
    grid = {"n_estimators": [2, 4], "max_depth": [2, 3], "learning_rate": [0.3], "subsample": [1.0], "colsample_bytree": [1.0]}
    found = training.grid_search(df, ["a", "b", "c"], "key", grid, folds=2).collect()
    assert len(found) == 4 and sum(r.is_best for r in found) == 1
    best = max(r.mean_f1 for r in found)
    assert next(r.mean_f1 for r in found if r.is_best) == best > 0.5


def test_grid_leaves_the_worse_half(spark):
    rows = [(i, t, x, y, z) for i, (t, _, _, _, x, y, z) in enumerate(sample(200))]
    df = spark.createDataFrame(rows, "key int, label_id int, a double, b double, c double")
    grid = {"n_estimators": [1, 3], "max_depth": [3], "learning_rate": [0.5, 1e-9], "subsample": [1.0], "colsample_bytree": [1.0]}
    whole = {r.parameters: r for r in training.grid_search(df, ["a", "b", "c"], "key", grid, folds=2).collect()}
    halved = {r.parameters: r for r in training.grid_search(df, ["a", "b", "c"], "key", grid, folds=2, halve_at=(2,)).collect()}
    assert halved.keys() == whole.keys() and sorted(r.rounds for r in halved.values()) == [1, 1, 2, 3]
    left = [p for p, r in halved.items() if r.rounds == 3]
    assert halved[left[0]].mean_f1 == whole[left[0]].mean_f1 and sum(r.is_best for r in halved.values()) == 1


def test_a_search_gives_the_same_whichever_way(spark, monkeypatch):
    rows = frame(spark, sample(400)).repartition(3)
    fits = [*FITS[:2], Fit(held=0, depth=6, subsample=0.7, columns=0.7)]
    ways = []
    for sent, margins in ((1 << 23, 1 << 32), (0, 1 << 32), (0, 1)):
        monkeypatch.setattr(boosting, "SENT", sent)
        monkeypatch.setattr(boosting, "MARGINS", margins)
        ways.append(boosting.tallies(rows, ["a", "b", "c"], fits, 3, [1, 3], 8))
    held = [sum(r[2] == fit.held for r in sample(400)) for fit in fits]
    for (m, stop), matrix in ways[0].items():
        assert matrix.sum() == held[m] and all((way[m, stop] == matrix).all() for way in ways)


def test_registered_search_fits_all_rows_to_the_end(spark, monkeypatch):
    from netweave.plans import learning

    rows = [(i, t, x, y, z) for i, (t, _, _, _, x, y, z) in enumerate(sample(2600))]
    df = spark.createDataFrame(rows, "shuffle_key int, label_id int, a double, b double, c double")
    seen, grid = {}, {"n_estimators": [1, 3], "max_depth": [2], "learning_rate": [0.3, 1e-9], "subsample": [1.0], "colsample_bytree": [1.0]}
    inner, whole = training.tallies, training.grid_search

    def tallies(fitted, *args):
        seen["rows"] = fitted.count()
        return inner(fitted, *args)

    monkeypatch.setattr(training, "tallies", tallies)
    monkeypatch.setattr(training, "grid_search", lambda *args, **named: whole(*args, grid=grid, **named))
    monkeypatch.setattr(learning, "learnable", lambda *a: df)
    monkeypatch.setattr(learning, "prepared", lambda *a: a[-1]())
    monkeypatch.setattr(learning, "FLOW_NUMERIC", ["a", "b", "c"])
    found = learning.grid_scores(spark, None).collect()
    assert seen["rows"] == 2600 and sorted(r.rounds for r in found) == [1, 1, 3, 3]


def test_weighted_f1_of_a_known_matrix():
    matrix = np.array([[8, 2], [1, 9]])
    a, b = 16 / 19, 18 / 20.0
    b = 2 * 9 / (10 + 11)
    assert abs(training.weighted_f1(matrix) - (a + b) / 2) < 1e-12


def test_scores_and_files_of_a_classifier(spark):
    from netweave.session import work_path

    rows = [(i, t, x, y, z, "train" if i % 4 else "validation") for i, (t, _, _, _, x, y, z) in enumerate(sample(300))]
    df = spark.createDataFrame([*rows, (999, 1, float("nan"), None, float("inf"), "train")], "key int, label_id int, a double, b double, c double, part string")
    model = training.train(df, ["a", "b", "c"], "boosted", rounds=5)
    scored = model.score(df)
    assert scored.count() == len(rows) + 1 and model.score_valid(df).count() == len(rows)
    odd = scored.where(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda s, p: s + p) - 1) > 1e-9)
    assert odd.count() == 0 and abs(model.importances().sum() - 1) < 1e-9
    path = work_path(spark, "boosted")
    model.save(spark, path)
    again = training.Classifier.load(spark, path)
    assert again.info() == model.info()
    assert again.score(df).exceptAll(scored).count() == 0
