from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prepaudit.operators import fairness, metrics, relevance, sample, train, weights

FEW = dict(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("aab"), int(rng.random() < 0.2), rng.random(), rng.randint(0, 9)) for i in range(600)]
    return spark.createDataFrame(rows, "id long, g string, y int, x double, w long").repartition(6), rows


def test_splits_do_not_depend_on_partitions(people):
    df, _ = people
    for split in (lambda d: sample.hash_split(d, "id"), lambda d: sample.stratified_split(d, "id", "y")):
        a = {r["id"]: r["split"] for r in split(df).collect()}
        b = {r["id"]: r["split"] for r in split(df.repartition(2).orderBy("x")).collect()}
        assert a == b


def test_stratified_split_keeps_shares(people):
    df, rows = people
    got = Counter((r["y"], r["split"]) for r in sample.stratified_split(df, "id", "y", 0.7).collect())
    for y, n in Counter(r[2] for r in rows).items():
        assert got[y, "train"] == int(np.ceil(0.7 * n))


def test_folds_partition_the_rows_evenly_in_each_class(people):
    df, rows = people
    got = Counter((r["y"], r["fold"]) for r in sample.stratified_folds(df, "id", "y", 4).collect())
    assert sum(got.values()) == len(rows)
    for y in (0, 1):
        sizes = [got[y, f] for f in range(4)]
        assert max(sizes) - min(sizes) <= 1


def test_undersample_evens_out_classes(people):
    df, rows = people
    got = Counter(r["y"] for r in sample.undersample(df, "id", "y").collect())
    assert got[0] == got[1] == min(Counter(r[2] for r in rows).values())


def test_sample_by_class_keeps_other_classes_whole(people):
    df, rows = people
    got = Counter(r["y"] for r in sample.sample_by_class(df, "id", "y", {0: 0.5}).collect())
    size = Counter(r[2] for r in rows)
    assert got[1] == size[1] and 0.35 * size[0] < got[0] < 0.65 * size[0]


def test_bootstrap_keeps_class_sizes_and_follows_weights(people):
    df, rows = people
    got = sample.bootstrap(df, "id", "w", ["y"]).collect()
    assert Counter(r["y"] for r in got) == Counter(r[2] for r in rows)
    weight = {r[0]: r[4] for r in rows}
    assert all(weight[r["id"]] > 0 for r in got)
    assert np.mean([weight[r["id"]] for r in got]) > np.mean(list(weight.values())) + 1


def test_bootstrap_with_one_heavy_row(spark):
    df = spark.createDataFrame([(i, 10**6 if i == 3 else 0) for i in range(40)], "id long, w long")
    assert Counter(r["id"] for r in sample.bootstrap(df, "id", "w").collect()) == {3: 40}


def test_smote_fills_up_the_minority_between_its_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=2)], int(i >= 30)) for i in range(37)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    made = sample.smote(df, "id", "v", "y", 3).collect()
    assert len(made) == 30 - 7 and {r["y"] for r in made} == {1}
    at = {i: np.array(v) for i, v, _ in rows}
    for r in made:
        a, b, p = at[r["id"]], at[r["neighbour"]], np.array(r["v"])
        u = np.dot(p - a, b - a) / np.dot(b - a, b - a)
        assert 0 <= u < 1 and np.allclose(p, a + u * (b - a))


def test_noise_has_the_stated_spread(people):
    df, _ = people
    noise = sample.add_noise(df, "id", ["x"], 15.0, suffix="_n").select(F.col("x_n") - F.col("x"))
    values = [r[0] for r in noise.collect()]
    assert abs(np.mean(values)) < 2 and 13 < np.std(values) < 17


def test_classification_report_by_hand(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    got = {r["label"]: tuple(r)[1:] for r in metrics.classification_report(df, "y", "p").collect()}
    named = metrics.classification_report(df, "y", "p", names={"a": "first"})
    assert {r["label"] for r in named.collect()} == {"first", "b", "c", "accuracy", "macro avg", "weighted avg"}
    assert got["a"] == (1.0, 0.5, pytest.approx(2 / 3), 2)
    assert got["b"] == (pytest.approx(1 / 3), 1.0, 0.5, 1)
    assert got["c"] == (0.0, 0.0, 0.0, 1)
    assert got["accuracy"] == (None, None, 0.5, 4)
    assert got["macro avg"][0] == pytest.approx(4 / 9)
    assert got["weighted avg"][1] == pytest.approx(0.5)


def test_report_per_slice_equals_report_of_the_slice(people):
    df, _ = people
    df = df.withColumn("p", (F.col("x") > 0.7).cast("int"))
    sliced = {(r["g"], r["label"]): tuple(r)[1:] for r in metrics.classification_report(df, "y", "p", ["g"]).collect()}
    for g in "ab":
        for r in metrics.classification_report(df.filter(F.col("g") == g), "y", "p").collect():
            assert sliced[g, r["label"]] == pytest.approx(tuple(r))


def test_confusion_matrix_has_empty_cells(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, p int")
    assert {tuple(r) for r in metrics.confusion_matrix(df, "y", "p", [0, 1]).collect()} == {
        (0, 0, 1), (0, 1, 0), (1, 0, 1), (1, 1, 0)}


@settings(**FEW)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(-5, 5)), min_size=2, max_size=30))
def test_auc_matches_pairs_and_ignores_monotone_maps(spark, rows):
    df = spark.createDataFrame(rows, "y int, s int")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    got = metrics.roc_auc(df, "y", "s").first()["auc"]
    mapped = metrics.roc_auc(df.withColumn("s", F.exp(F.col("s").cast("double")) * 3), "y", "s").first()["auc"]
    if not pos or not neg:
        assert got is None and mapped is None
    else:
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got == pytest.approx(wins / len(pos) / len(neg)) == mapped


def test_regression_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0)], "y double, p double")
    got = metrics.regression_metrics(df, "y", "p").first()
    assert (got["mae"], got["mse"]) == pytest.approx((1.0, 5 / 3)) and got["r2"] == pytest.approx(-1.5)


def test_fairness_by_hand(spark):
    rows = [("m", 1, 1), ("m", 1, 0), ("m", 0, 1), ("m", 0, 0), ("f", 1, 1), ("f", 0, 0), ("x", 1, 1)]
    got = fairness.fairness_metrics(spark.createDataFrame(rows, "g string, y int, p int"), "y", "p", "g", "m", ["f"]).first()
    assert tuple(got) == (1.0, 0.0, 0.5)


def test_reweighing_makes_the_label_independent_of_the_group(people):
    df, _ = people
    w = defaultdict(float)
    for r in weights.reweighing(df, "g", "y").collect():
        w[r["g"], r["y"]] += r["weight"]
    rates = [w[g, 1] / (w[g, 0] + w[g, 1]) for g in "ab"]
    assert rates[0] == pytest.approx(rates[1])


def test_class_weights_even_out_classes(people):
    df, _ = people
    sums = weights.class_weights(df, "y").groupBy("y").agg(F.sum("weight")).collect()
    assert sums[0][1] == pytest.approx(sums[1][1])


def test_anova_matches_numpy(people):
    df, rows = people
    groups = [np.array([r[3] for r in rows if r[1] == g]) for g in "ab"]
    every = np.concatenate(groups)
    between = sum(len(g) * (g.mean() - every.mean()) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(every) - 2)
    assert relevance.anova_f(df, ["x"], "g").first()["f_score"] == pytest.approx(between / within)


def test_proxies_are_found_and_dropped(spark):
    rows = [(i, i % 2, (i % 2) * 3 + 1, i // 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, sex int, height int, age int")
    found = relevance.proxies(df, ["sex"], ["height", "age"])
    assert relevance.drop_proxies(df, ["sex"], found).columns == ["id", "age"]


@pytest.mark.parametrize("slices", [1, 7])
def test_permutation_importance_only_for_used_features(spark, people, slices):
    df, _ = people
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    df = df.withColumn("t", (F.col("x") > 0.5).cast("int"))
    got = {r["feature"]: r["importance"] for r in relevance.permutation_importance(
        df, "id", "t", ["x", "w"], lambda c: (c["x"] > 0.5).cast("int"), 3).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got["w"] == 0.0 and 0.3 < got["x"] < 0.7


def test_pipeline_learns_and_selects(people):
    df, _ = people
    df = sample.hash_split(df, "id").withColumn("t", (F.col("x") > 0.5).cast("double"))
    on = F.col("split") == "train"
    stages = [*train.preprocessing(["x"], ["g"]), train.logistic_regression(df.count(), "t")]
    predicted = train.fit_predict(stages, df, on).filter(~on)
    assert metrics.accuracy(predicted, "t", "prediction").first()["accuracy"] > 0.95
    kept = {r["feature"]: r["kept"] for r in train.select_from_model(df, ["x", "w"], "t", trees=5, depth=3).collect()}
    assert kept == {"x": True, "w": False}


def test_private_counts_are_close_and_noisy(people):
    df, _ = people
    exact = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    noisy = {r["g"]: r["noisy_count"] for r in train.private_counts(df, ["g"], 1.0, seed=1).collect()}
    assert all(0 < abs(noisy[g] - exact[g]) < 20 for g in exact)


def test_search_and_cross_validation_refit_per_fold(people):
    df, _ = people
    rows = sample.stratified_folds(df, "id", "y", 2).withColumn("t", (F.col("x") > 0.5).cast("double")).persist()
    stages = [*train.preprocessing(["x"], fill=None), train.logistic_regression(300, "t")]
    found = train.grid_search(rows, stages, {"regParam": [0.001, 100.0], "elasticNetParam": [1.0]}, "t", "fold", 2).collect()
    assert len(found) == 2 and [r["best"] for r in found] == [True, False]
    assert found[0]["mean_score"] > 0.9 > found[1]["mean_score"]
    scores = train.cross_validate(rows, stages, "t", "fold", 2)
    assert {r["fold"] for r in scores.collect()} == {0, 1}
    assert metrics.cv_summary(scores, "score").first()["mean"] > 0.9
    rows.unpersist()


def test_fair_training_reports_both_gaps(spark):
    rng = random.Random(2)
    rows = [(i, g, float(rng.random() < (0.8 if g else 0.2)), float(g)) for i in range(400) for g in [i % 2]]
    df = sample.hash_split(spark.createDataFrame(rows, "id long, g int, t double, x double"), "id")
    stages = [*train.preprocessing(["x"], fill=None), train.logistic_regression(400, "t")]
    got = {r["training"]: r["parity_gap"] for r in train.fair_training(df, stages, "t", "g", F.col("split") == "train").collect()}
    assert got["plain"] == 1.0 and got["reweighed"] <= got["plain"]


def test_forests_fit_both_kinds(people):
    df, _ = people
    df = sample.hash_split(df, "id").withColumn("t", (F.col("x") > 0.5).cast("double"))
    on = F.col("split") == "train"
    for label, regression in (("t", False), ("x", True)):
        stages = [train.assembler(["x"]), train.forest(label, trees=5, depth=5, regression=regression)]
        predicted = train.fit_predict(stages, df, on).filter(~on)
        assert metrics.regression_metrics(predicted, label, "prediction").first()["r2"] > 0.9


def test_permutation_moves_short_rows(spark, monkeypatch):
    """What is sorted and written per repeat holds the digest's 16 bytes and the features; the key stays behind."""
    kept, settle = [], relevance.settle
    monkeypatch.setattr(relevance, "settle", lambda df: kept.append(dict(df.dtypes)) or settle(df))
    df = spark.range(200).selectExpr("concat('a long key ', id) AS k", "cast(id % 2 AS double) AS y", "cast(id % 2 AS double) AS x")
    found = relevance.permutation_importance(df, "k", "y", ["x"], lambda given: given["x"], 3, 1).first()
    assert 0.3 < found["importance"] < 0.7
    assert kept == [{"__run": "int", "__h": "binary", "y": "double", "x": "double", "__slice": "int"}]
