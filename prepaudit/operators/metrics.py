"""Evaluation metrics, each one grouped aggregation for any number of slices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepaudit.functions.rows import stacked
from prepaudit.operators import gram
from prepaudit.operators.distributed import running_total, settle


def _hit(y: str, p: str) -> Column:
    return F.coalesce(F.col(y) == F.col(p), F.lit(False)).cast("double")


def accuracy(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(_hit(y, p)).alias("accuracy"), F.count("*").alias("n"))


def group_accuracy(df: DataFrame, y: str, p: str, group: str) -> DataFrame:
    """Accuracy and size per protected group; rows without a group are left out."""
    return accuracy(df.filter(F.col(group).isNotNull()), y, p, [group])


def confusion_matrix(df: DataFrame, y: str, p: str, classes: Sequence = (), by: Sequence[str] = ()) -> DataFrame:
    """Every cell ``(by..., actual, predicted, n)``, empty ones as 0, for the given classes and all that occur."""
    by = list(by)
    counted = settle(df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(
        *by, F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count("*").alias("n")))
    seen = F.array_union(F.collect_set("actual"), F.collect_set("predicted"))
    if classes:
        seen = F.array_union(seen, F.array(*[F.lit(c) for c in classes]).cast(counted.select(F.array("actual")).schema[0].dataType))
    listed = counted.groupBy(*by).agg(seen.alias("__classes"))
    grid = listed.select(*by, F.explode("__classes").alias("actual"), "__classes").select(
        *by, "actual", F.explode("__classes").alias("predicted"))
    cells = grid.join(counted, [*by, "actual", "predicted"], "left")
    return cells.select(*by, "actual", "predicted", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where nothing can be divided."""
    return F.coalesce(top / F.nullif(bottom, F.lit(0.0)), F.lit(0.0))


def classification_report(df: DataFrame, y: str, p: str, by: Sequence[str] = (),
                          names: Mapping | None = None) -> DataFrame:
    """``(by..., label, precision, recall, f1_score, support)``.

    One row per class seen as label or prediction, then ``accuracy`` (as
    f1_score), ``macro avg`` and ``weighted avg``. ``names`` renames classes.
    """
    by = list(by)
    pairs = df.groupBy(*by, F.col(y).cast("string").alias("__y"), F.col(p).cast("string").alias("__p")).agg(
        F.count("*").cast("double").alias("__n"))
    n, zero = F.col("__n"), F.lit(0.0)
    hit = F.when(F.col("__y") == F.col("__p"), n).otherwise(zero)
    sides = stacked({"label": F.col("__y"), "actual": n, "predicted": zero, "hits": hit},
                    {"label": F.col("__p"), "actual": zero, "predicted": n, "hits": zero})
    classes = pairs.select(*by, F.inline(sides)).filter(F.col("label").isNotNull()).groupBy(*by, "label").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    hits, actual = F.col("hits"), F.col("actual")
    scores = ["precision", "recall", "f1_score"]
    scored = classes.withColumns({
        "precision": _ratio(hits, F.col("predicted")), "recall": _ratio(hits, actual),
        "f1_score": _ratio(F.lit(2.0) * hits, F.col("predicted") + actual)})

    def row(label, values):
        return {"label": label, **{s: v.cast("double") for s, v in zip(scores, values)},
                "support": F.col("actual").cast("bigint")}
    totals = scored.groupingSets([[*by, "label"], by], *by, "label").agg(
        F.grouping("label").alias("__all"),
        *[F.avg(s).alias(f"m_{s}") for s in scores],
        *[_ratio(F.sum(F.col(s) * actual), F.sum("actual")).alias(f"w_{s}") for s in scores],
        F.sum("hits").alias("hits"), F.sum("actual").alias("actual"))
    macro = [F.col(f"m_{s}") for s in scores]
    weighted = [F.col(f"w_{s}") for s in scores]
    share = [F.lit(None), F.lit(None), _ratio(F.col("hits"), F.col("actual"))]
    shown = F.col("label")
    if names:
        pairs_of = [F.lit(str(x)) for pair in names.items() for x in pair]
        shown = F.coalesce(F.try_element_at(F.create_map(*pairs_of), shown), shown)
    one = stacked(row(shown, macro))
    three = stacked(row("accuracy", share), row("macro avg", macro), row("weighted avg", weighted))
    return totals.select(*by, F.inline(F.when(F.col("__all") == 0, one).otherwise(three)))


def roc_auc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half, from running counts of distinct scores."""
    by = list(by)
    counted = df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    ordered = running_total(counted, by, ["score"], negatives="neg")
    below = F.col("negatives") - F.col("neg") + F.col("neg") / F.lit(2.0)
    return ordered.groupBy(*by).agg(
        (F.sum(F.col("pos") * below) / F.nullif(F.sum("pos").cast("double") * F.sum("neg").cast("double"), F.lit(0.0))).alias("auc"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """R2, MAE, MSE and RMSE in one pass."""
    miss = F.col(y).cast("double") - F.col(p)
    sums = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(
        F.avg(F.abs(miss)).alias("mae"), F.avg(miss * miss).alias("mse"),
        F.var_pop(F.col(y).cast("double")).alias("__var"))
    return sums.select(*by, (F.lit(1.0) - F.col("mse") / F.nullif(F.col("__var"), F.lit(0.0))).alias("r2"),
                       "mae", "mse", F.sqrt("mse").alias("rmse"))


def shift_check(df: DataFrame, score: str, train: Column, threshold: float = 0.1) -> DataFrame:
    """One row: mean score of the train and of the other rows, and whether they differ too much."""
    means = df.agg(F.avg(F.when(train, F.col(score))).alias("train_mean"),
                   F.avg(F.when(~train, F.col(score))).alias("test_mean"))
    gap = F.abs(F.col("train_mean") - F.col("test_mean"))
    return means.withColumns({"gap": gap, "shifted": gap > F.lit(float(threshold))})


def shift_check_kernel(df: DataFrame, columns: Sequence[str], label: str, train: Column, threshold: float = 0.1, **options) -> DataFrame:
    """The same with scores of a kernel ridge regression fitted on the train rows (``gram.fourier_scores``)."""
    a, b = gram.fourier_scores(df, columns, label, train, **options)
    gap = abs(a - b)
    return df.sparkSession.createDataFrame([(a, b, gap, gap > threshold)], "train_mean double, test_mean double, gap double, shifted boolean")


def noise_robustness(df: DataFrame, y: str, clean: str, noisy: str) -> DataFrame:
    """Accuracy of the predictions on clean and on noisy features."""
    return df.agg(F.avg(_hit(y, clean)).alias("accuracy_clean"), F.avg(_hit(y, noisy)).alias("accuracy_noisy")
                  ).withColumn("loss", F.col("accuracy_clean") - F.col("accuracy_noisy"))


def cv_summary(fold_scores: DataFrame, score: str) -> DataFrame:
    """Mean and population deviation of the fold scores, and the two-deviation band."""
    return fold_scores.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std")).withColumn(
        "two_std", F.lit(2.0) * F.col("std"))


def fold_metrics(df: DataFrame, y: str, p: str, score: str, fold: str) -> DataFrame:
    """Accuracy, precision, recall, F1 of the class 1 and ROC AUC per fold."""
    yes, said = F.col(y) == 1, F.col(p) == 1
    sums = df.groupBy(fold).agg(
        F.avg(_hit(y, p)).alias("accuracy"), F.count_if(yes & said).cast("double").alias("__tp"),
        F.count_if(said).cast("double").alias("__said"), F.count_if(yes).cast("double").alias("__yes"))
    scored = sums.select(fold, "accuracy", _ratio(F.col("__tp"), F.col("__said")).alias("precision"),
                         _ratio(F.col("__tp"), F.col("__yes")).alias("recall"),
                         _ratio(F.lit(2.0) * F.col("__tp"), F.col("__said") + F.col("__yes")).alias("f1_score"))
    return scored.join(roc_auc(df, y, score, [fold]).select(fold, "auc"), fold)
