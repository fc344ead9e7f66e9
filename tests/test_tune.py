"""The search of settings."""

import random

import pytest

from sparkstill.operators import boost, student, tune

WIDTH = 20


@pytest.fixture(scope="module")
def frame(spark):
    r = random.Random(5)
    rows = []
    for k in range(1500):
        x = [r.choice([0, 0, 1, 2]) for _ in range(WIDTH)]
        y = sum(x[:5]) + 2 * (x[5] > 0) * (x[6] > 0) + r.gauss(0, 1.5)
        rows.append((k, [(i, c) for i, c in enumerate(x) if c], y, float(y > 7), k % 5 == 0))
    return spark.createDataFrame(rows, "row_id long, pairs array<struct<i:int,c:int>>, y double, label double, is_val boolean").repartition(4).cache()


def test_rungs_grow_fewer_trees_than_random_search_for_the_same_loss(frame):
    fits = boost.Boosting(frame, "y", WIDTH, [{}])
    fixed = {"min_child_weight": 20.0, "max_depth": 3}
    found = tune.search(fits, 8, 12, fixed=fixed)
    plain = tune.search(fits, 8, 12, fixed=fixed, proposals=lambda done, n, r: [tune._settings((r.random(), r.random())) for _ in range(n)], rungs=())
    again = tune.search(fits, 8, 12, fixed=fixed)
    fits.close()
    assert found == again
    assert found["trees"] < 0.8 * plain["trees"] and found["best"]["loss"] <= plain["best"]["loss"] * 1.01
    assert any(t["pruned"] for t in found["trials"]) and len(found["trials"]) == 8


def test_proposals_go_where_losses_are_low():
    """The ratio of densities draws near the better trials."""
    r = random.Random(1)
    done = [(tune._settings((k / 20, 0.5)), abs(k / 20 - 0.7)) for k in range(21)]
    got = [tune._unit(s)[0] for s in tune.propose(done, 20, r)]
    assert sum(0.5 < x < 0.9 for x in got) >= 14
    for s in tune.propose([], 50, r):
        assert 0.05 <= s["learning_rate"] <= 0.3 and 0 <= s["min_split_gain"] <= 5


def test_only_the_better_half_goes_on():
    assert tune.halved({0: 1.0, 1: 2.0, 2: 3.0, 3: 4.0}, []) == [0, 1]
    assert tune.halved({0: 5.0, 1: 6.0}, [1.0, 2.0, 3.0, 4.0]) == []


def test_tune_gives_settings_and_its_trials(frame):
    found = tune.tune(frame, "y", WIDTH, n=3, rounds=4, most_rows=700, max_depth=3)
    assert set(tune.TUNED) <= set(found) and found["rmse"] > 0 and len(found["trials"]) == 3


def test_student_fits_once_with_weighted_validation(frame, monkeypatch):
    from pyspark.sql import functions as F

    made = []
    real = boost.Boosting.__init__
    monkeypatch.setattr(boost.Boosting, "__init__", lambda self, *a, **b: made.append(1) or real(self, *a, **b))
    heavy = frame.withColumn("w", F.when(F.col("y") > 8, 10.0).otherwise(1.0))
    a = student.fit_student(heavy, "y", WIDTH, weight="w", rounds=6, max_depth=3)
    b = student.fit_student(heavy, "y", WIDTH, rounds=6, max_depth=3)
    assert len(made) == 2 and a.model.losses[0] != b.model.losses[0]
    loss = heavy.where("is_val").agg(F.sum(F.col("w") * (F.col("y") - F.lit(a.model.base)) ** 2) / F.sum("w")).first()[0]
    assert a.model.losses[0] == pytest.approx(loss)


def test_the_best_preset_of_a_portfolio_wins(frame):
    """Planted: one preset cannot split, one learns; the record has all scores."""
    presets = {"stump": {"max_depth": 0}, "learns": {"max_depth": 3}, "still": {"learning_rate": 1e-6}}
    head = student.fit_head(frame.drop("is_val"), "label", WIDTH, rounds=12, presets=presets, min_child_weight=3.0)
    report = head.report()
    assert report["preset"] == "learns" and set(report["portfolio_scores"]) == set(presets) and report["selected_score"] == min(report["portfolio_scores"].values())
    scored = student.head_score(head.model, frame).select("hard", "label").toPandas()
    assert scored[scored.label == 1].hard.mean() > scored[scored.label == 0].hard.mean() + 0.05


def test_inner_splits_are_stratified(frame):
    got = {(r["label"], r["is_val"]): r["n"] for r in student.inner_split(frame.drop("is_val"), "label").groupBy("label", "is_val").count().withColumnRenamed("count", "n").collect()}
    for c in (0.0, 1.0):
        n = got[c, True] + got[c, False]
        assert got[c, True] == round(0.2 * n)
