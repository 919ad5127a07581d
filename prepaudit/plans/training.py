"""Training queries: results are models' outputs, so they are checked by rows and by tests, not by SQL."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from prepaudit.operators import forest, linear, metrics, parity, private, relevance, sample, train, weights
from prepaudit.plans.inputs import SEED, fine_uniform_sql, labelled, rounded, scored, table, wide_table
from prepaudit.plans.registry import query

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _items(spark, folder):
    """Line items with the label "returned" and a split that keeps an order together."""
    items = wide_table(spark, folder, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", *NUMBERS)
    return sample.hash_split(items, "l_orderkey", seed=SEED).withColumn(
        "y", (F.col("l_returnflag") == "R").cast("double"))


def _train():
    return F.col("split") == "train"


@query("train_logreg")
def train_logreg(spark, folder):
    items = _items(spark, folder)
    rows = items.filter(_train()).count()
    stages = [*train.preprocessing(NUMBERS, fill=None), train.logistic_regression(rows, "y")]
    predicted = train.fit_predict(stages, items, _train()).filter(~_train())
    judged = predicted.select(F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("p"))
    return rounded(metrics.classification_report(judged, "y", "p"))


@query("train_forest")
def train_forest(spark, folder):
    items = _items(spark, folder)
    model = train.forest("y", columns=NUMBERS).fit(items.filter(_train()))
    predicted = model.transform(items.filter(~_train()))
    judged = predicted.select("l_linestatus", "y", F.col("prediction").alias("p"))
    return rounded(metrics.group_accuracy(judged, "y", "p", "l_linestatus"))


@query("train_forest_reg")
def train_forest_reg(spark, folder):
    features = ["l_quantity", "l_discount", "l_tax"]
    items = _items(spark, folder)
    model = train.forest("l_extendedprice", regression=True, columns=features).fit(items.filter(_train()))
    predicted = model.transform(items.filter(~_train()))
    return rounded(metrics.regression_metrics(predicted, "l_extendedprice", "prediction"))


@query("train_stages")
def train_stages(spark, folder):
    """Undersample the train rows, then one pipeline of fill, one-hot, scale and model."""
    rows = scored(spark, folder).withColumn("y", F.col("quality").cast("double"))
    balanced = sample.undersample(rows.filter(_train()), "doc_id", "quality", SEED)
    stages = [*train.preprocessing(["n_chars"], ["lang"]), train.logistic_regression(balanced.count(), "y")]
    predicted = train.fit_predict(stages, balanced.unionByName(rows.filter(~_train())), _train())
    tested = predicted.filter(~_train()).withColumn("score", train.positive_probability())
    return rounded(metrics.roc_auc(tested, "quality", "score"))


def _labelled_folds(spark, folder):
    folds = sample.stratified_folds(labelled(spark, folder), "doc_id", "quality", 5, SEED)
    return folds.select("fold", F.col("quality").alias("y"), "n_chars", "lang")


#: Strengths as Spark's learner states them, per row, and shares of the penalty on absolute weights.
GRID = [{"regParam": r, "elasticNetParam": e} for r in (0.001, 0.01, 0.1) for e in (0.0, 1.0)]


@query("grid_search")
def grid_search(spark, folder):
    """Six points on five folds, all fitted in the same scans."""
    return rounded(linear.grid_search(_labelled_folds(spark, folder), ["n_chars"], ["lang"], "y", "fold", GRID, 5, fill="median"))


@query("grid_search_forest")
def grid_search_forest(spark, folder):
    """All 108 points of trees, depth, split and leaf size on five folds."""
    folds = sample.stratified_folds(labelled(spark, folder), "doc_id", "quality", 5, SEED).withColumns(
        {"half": F.col("n_chars") % 2, "rest": F.col("n_chars") % 7})
    return rounded(forest.grid_search(folds, ["n_chars", "toxic", "half", "rest"], "quality", "fold", "doc_id"))


@query("cv_refit")
def cv_refit(spark, folder):
    folds = _labelled_folds(spark, folder)
    point = {"regParam": 1 / folds.count()}
    found = linear.cross_validate(folds, ["n_chars"], ["lang"], "y", "fold", point, 5, fill="median")
    return rounded(metrics.cv_summary(found, "accuracy"))


@query("cv_resampled")
def cv_resampled(spark, folder):
    """Undersampling, choice of features and forest, all fitted anew on the train rows of each fold."""
    rows = sample.stratified_folds(labelled(spark, folder), "doc_id", "quality", 5, SEED).withColumn(
        "y", F.col("quality").cast("double")).withColumns({"half": F.col("n_chars") % 2, "rest": F.col("n_chars") % 7})
    stages = [train.resampled(lambda known: sample.undersample(known, "doc_id", "quality", SEED)),
              train.selected(["n_chars", "toxic", "half", "rest"], "y", 2), train.forest("y")]
    return rounded(metrics.cv_summary(train.cross_validate(rows, stages, "y", "fold"), "score"))


@query("select_from_model")
def select_from_model(spark, folder):
    return rounded(train.select_from_model(_items(spark, folder).filter(_train()), NUMBERS, "y"))


@query("fair_train")
def fair_train(spark, folder):
    rows = scored(spark, folder).withColumn("y", F.col("quality").cast("double"))
    stages = [*train.preprocessing(["n_chars"]), train.logistic_regression(rows.count(), "y")]
    return rounded(train.fair_training(rows, stages, "y", "lang", _train()))


@query("fair_train_constrained")
def fair_train_constrained(spark, folder):
    """Languages' shares of positive predictions: unconstrained, reweighed, and under a bound of 0.02, on train and test rows.

    The label is a good document of at least the mean length, which languages have in different shares.
    """
    rows = scored(spark, folder).withColumn("y", ((F.col("quality") == 1) & (F.col("pred") == 1)).cast("double"))
    known = rows.filter(_train())
    stages = [*train.preprocessing(["n_chars", "toxic"], ["lang"], fill=None), train.logistic_regression(known.count(), "y")]
    plain = train.fit_predict(stages, rows, _train())
    weighted = train.fit([*stages[:-1], stages[-1].copy().setWeightCol("weight")], weights.reweighing(known, "lang", "y")).transform(rows)
    mixture = parity.train(known, ["n_chars", "toxic"], ["lang"], "y", "lang", bound=0.02)
    told = [("plain", plain.withColumn("chance", F.col("prediction"))), ("reweighed", weighted.withColumn("chance", F.col("prediction"))),
            ("constrained", rows.withColumn("chance", mixture.chance()))]
    every = functools.reduce(lambda a, b: a.unionByName(b), [
        df.select(F.lit(name).alias("training"), "split", "lang", "y", "chance") for name, df in told])
    wrong = F.when(F.col("y") == 1, 1 - F.col("chance")).otherwise(F.col("chance"))
    by_group = every.groupBy("training", "split", "lang").agg(F.avg("chance").alias("rate"), F.sum(wrong).alias("wrong"), F.count("*").alias("n"))
    return rounded(by_group.groupBy("training", "split").agg(
        (F.max("rate") - F.min("rate")).alias("parity_gap"), (F.sum("wrong") / F.sum("n")).alias("error")))


@query("dp_forest")
def dp_forest(spark, folder):
    """Private forest (epsilon 1, seeded as the result is compared) for good documents of at least the mean length; bounds are stated, not read."""
    rows = scored(spark, folder).withColumn("y", ((F.col("quality") == 1) & (F.col("pred") == 1)).cast("int"))
    model = private.fit(rows.filter(_train()), {"n_chars": (0, 8000), "toxic": (0, 1)}, "y", "doc_id", epsilon=1.0, trees=10, depth=6, seed=SEED)
    judged = model.transform(rows.filter(~_train())).select("y", F.col("prediction").cast("int").alias("p"))
    return rounded(metrics.classification_report(judged, "y", "p"))


# A seed, as the result is compared; the library draws without one.
@query("dp_counts", f"""
    WITH c AS (SELECT lang, source, count(*)::DOUBLE AS n, {fine_uniform_sql("lang, source")} - 0.5::DOUBLE AS u
               FROM documents GROUP BY lang, source)
    SELECT lang, source, round(n - sign(u) * ln(1.0::DOUBLE - 2.0::DOUBLE * abs(u)), 6) AS noisy_count FROM c""")
def dp_counts(spark, folder):
    counted = table(spark, folder, "documents", "lang", "source")
    return rounded(train.private_counts(counted, ["lang", "source"], epsilon=1.0, seed=SEED))


@query("permutation_importance_model")
def permutation_importance_model(spark, folder):
    """Permutation importance of a fitted logistic regression, scored as a column expression."""
    items = _items(spark, folder).withColumn("key", F.concat_ws("/", "l_orderkey", "l_returnflag", *NUMBERS))
    known = items.filter(_train())
    stages = [train.assembler(NUMBERS), train.logistic_regression(known.count(), "y")]
    model = train.fit(stages, known).stages[-1]

    def predict(given):
        margin = F.lit(float(model.intercept))
        for name, weight in zip(NUMBERS, model.coefficients):
            margin = margin + F.lit(float(weight)) * given[name]
        return (margin > 0).cast("double")
    return rounded(relevance.permutation_importance(items.filter(~_train()), "key", "y", NUMBERS, predict, 10, SEED))
