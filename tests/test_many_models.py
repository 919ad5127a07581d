"""Many models in one scan against fits one by one, and training under a parity bound."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from prepaudit.operators import linear, parity, train


@pytest.fixture(scope="module")
def people(spark):
    rnd, rows = random.Random(11), []
    for i in range(600):
        group = rnd.choice("aab")
        x = rnd.gauss(1000 if group == "a" else 700, 300)
        y = int(x + rnd.gauss(0, 250) > 900)
        rows.append((i, i % 3, x, rnd.random() if rnd.random() < 0.9 else None, group if rnd.random() < 0.95 else "rare" if i < 40 else "c", y))
    return spark.createDataFrame(rows, "id int, fold int, x double, z double, g string, y int").repartition(4).persist()


def one_by_one(df, fold, point, fill):
    """The fold's train rows through Spark's own stages and learner, and accuracy on the rest."""
    known, other = df.filter(F.col("fold") != fold), df.filter(F.col("fold") == fold)
    stages = [train.filled(["x", "z"], fill), StringIndexer(inputCol="g", outputCol="gi", handleInvalid="keep", stringOrderType="alphabetAsc"),
              OneHotEncoder(inputCol="gi", outputCol="gh"), VectorAssembler(inputCols=["x__filled", "z__filled", "gh"], outputCol="raw"),
              train.standardised("raw", "features"),
              LogisticRegression(labelCol="y", regParam=point["regParam"], elasticNetParam=point["elasticNetParam"], standardization=False,
                                 maxIter=200, tol=1e-12)]
    model = train.fit(stages, known)
    learner = model.stages[-1]
    right = model.transform(other).filter("prediction = y").count() / other.count()
    return np.append(learner.coefficients.toArray(), learner.intercept), right


@pytest.mark.parametrize("fill", ["median", "mean"])
def test_grid_agrees_with_separate_fits(people, fill):
    points = [{"regParam": 0.01, "elasticNetParam": 0.0}, {"regParam": 0.05, "elasticNetParam": 1.0}, {"regParam": 0.02, "elasticNetParam": 0.3}]
    grid = linear.FoldedGrid(people, ["x", "z"], ["g"], "y", "fold", 3, points, fill)
    accuracy = linear.scores(grid.confusion(), "accuracy")
    for fold, j in ((0, 0), (1, 1), (2, 2)):
        known = people.filter(F.col("fold") != fold)
        wanted, right = one_by_one(people, fold, points[j], fill)
        assert accuracy[fold, j] == pytest.approx(right)
        # margins of both on the train rows, whatever the columns' scale
        values = sorted({r["g"] for r in known.select("g").distinct().collect()})
        filled = train.filled(["x", "z"], fill).fit(known)[0].orderBy("id").collect()
        matrix = np.array([[r["x__filled"], r["z__filled"], *[float(r["g"] == v) for v in values]] for r in filled])
        spread = matrix.std(0)
        margins = (matrix - matrix.mean(0)) / np.where(spread > 0, spread, 1) @ wanted[:-1] + wanted[-1]
        rows = known.select(*[e.alias(n) for n, e in grid.design.expressions.items()], "id").orderBy("id").collect()
        shared = np.array([[0.0 if r[c] is None else (r[c] - grid.design.center[k]) / grid.design.scale[k]
                            for k, c in enumerate(grid.design.columns)] + [1.0] for r in rows])
        assert np.abs(shared @ grid.solutions[fold * len(points) + j].weights - margins).max() < 1e-5
        told = known.select(grid.design.margin(grid.solutions[fold * len(points) + j].weights).alias("m"), "id").orderBy("id").collect()
        assert max(abs(r["m"] - m) for r, m in zip(told, margins)) < 1e-5


def test_number_of_scans_does_not_grow_with_models(people, monkeypatch):
    scans = []
    inner = linear._pass
    monkeypatch.setattr(linear, "_pass", lambda *a, **k: scans.append(len(a[1])) or inner(*a, **k))
    linear.FoldedGrid(people, ["x"], [], "y", "fold", 3, [{"regParam": 0.1}])
    few = len(scans)
    scans.clear()
    linear.FoldedGrid(people, ["x"], [], "y", "fold", 3, [{"regParam": 0.1 + i / 100} for i in range(20)])
    assert len(scans) <= few + 1 and max(scans) == 60


def test_models_beyond_one_pass_are_taken_in_turn(people, monkeypatch):
    points = [{"regParam": r} for r in (0.01, 0.1, 1.0)]
    whole = linear.grid_search(people, ["x"], ["g"], "y", "fold", points, 3).collect()
    monkeypatch.setattr(linear, "PASS_NUMBERS", 100)
    assert linear.grid_search(people, ["x"], ["g"], "y", "fold", points, 3).collect() == whole
    assert [r["best"] for r in whole].count(True) == 1


def test_folds_metrics_and_nulls(people):
    found = linear.cross_validate(people, ["x"], [], "y", "fold", {"regParam": 0.01}, 3, ["accuracy", "precision", "recall", "f1"]).collect()
    assert [r["fold"] for r in found] == [0, 1, 2]
    for r in found:
        assert r["f1"] == pytest.approx(2 * r["precision"] * r["recall"] / (r["precision"] + r["recall"]))
    with pytest.raises(ValueError, match="null"):
        linear.cross_validate(people, ["z"], [], "y", "fold", {"regParam": 0.01}, 3)


def test_constant_and_empty_columns(spark):
    rows = [(i % 2, 5.0, None, i % 3 % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "fold int, same double, none double, y int")
    found = linear.cross_validate(df, ["same", "none"], [], "y", "fold", {"regParam": 0.1}, 2, fill="mean").collect()
    assert [r["accuracy"] for r in found] == [pytest.approx(2 / 3)] * 2


def test_tree_sum_in_two_steps(people, monkeypatch):
    plain = linear.grid_search(people, ["x"], [], "y", "fold", [{"regParam": 0.1}], 3).collect()
    monkeypatch.setattr(linear, "GROUPS", 2)
    assert linear.grid_search(people, ["x"], [], "y", "fold", [{"regParam": 0.1}], 3).collect() == plain


def test_game_of_known_value():
    rows, columns, value = parity.solve_game(np.array([[0.0, -1.0, 1.0], [1.0, 0.0, -1.0], [-1.0, 1.0, 0.0]]))
    assert rows == pytest.approx([1 / 3] * 3) and columns == pytest.approx([1 / 3] * 3) and value == pytest.approx(0)
    rng = np.random.default_rng(0)
    for _ in range(50):
        payoff = rng.normal(size=(rng.integers(1, 12), rng.integers(1, 9)))
        rows, columns, value = parity.solve_game(payoff)
        assert rows.sum() == pytest.approx(1) and columns.sum() == pytest.approx(1) and min(rows.min(), columns.min()) >= -1e-9
        assert (rows @ payoff).max() == pytest.approx(value) == (payoff @ columns).min()


def test_parity_bound_holds_and_the_game_closes(people):
    base = people.filter("g IN ('a', 'b')").select("id", "x", "g", "y")
    mixture = parity.train(base, ["x"], ["g"], "y", "g", bound=0.02, gap=0.01)
    told = base.withColumn("chance", mixture.chance()).withColumn("wrong", F.when(F.col("y") == 1, 1 - F.col("chance")).otherwise(F.col("chance")))
    overall = told.agg(F.avg("chance")).first()[0]
    for r in told.groupBy("g").agg(F.avg("chance").alias("rate")).collect():
        assert abs(r["rate"] - overall) <= 0.02 + 1e-6
    last = mixture.rounds[-1]
    assert last.upper - last.lower <= 0.01 and last.violation <= 0.02 + 1e-9
    assert told.agg(F.avg("wrong")).first()[0] == pytest.approx(last.error)
    assert mixture.rounds[0].violation > 0.1  # what the unconstrained model does
    assert sum(mixture.shares) == pytest.approx(1)
    drawn = mixture.transform(base, "id", 5)
    assert drawn.select("prediction").collect() == mixture.transform(base, "id", 5).select("prediction").collect()


def test_group_with_nulls(spark):
    rnd = random.Random(3)
    rows = [(rnd.gauss(i % 2, 1), None if i % 2 else "v", int(rnd.random() < 0.3 + 0.4 * (i % 2))) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, g string, y int")
    mixture = parity.train(df, ["x"], [], "y", "g", bound=0.05, max_rounds=12)
    rates = [r["r"] for r in df.groupBy("g").agg(F.avg(mixture.chance()).alias("r")).collect()]
    assert max(rates) - min(rates) <= 0.1 + 1e-6
