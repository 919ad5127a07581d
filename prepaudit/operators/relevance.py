"""Feature selection and relevance."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepaudit.functions.hashing import digest
from prepaudit.functions.rows import stacked
from prepaudit.operators import gram
from prepaudit.operators.clean import first_rows
from prepaudit.operators.distributed import settle


def anova_f(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``(feature, f_score)`` from one aggregation: count, mean and spread of every feature per class."""
    wide = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(*[x for i, c in enumerate(features) for x in (
        F.count(F.col(c).cast("double")).cast("double").alias(f"n{i}"), F.avg(F.col(c).cast("double")).alias(f"m{i}"),
        F.var_pop(F.col(c).cast("double")).alias(f"v{i}"))])
    groups = wide.select("label", F.inline(stacked(*[
        {"feature": c, "n": F.col(f"n{i}"), "mean": F.col(f"m{i}"), "var": F.col(f"v{i}")} for i, c in enumerate(features)])))
    groups = groups.filter(F.col("n") > 0)
    grand = F.sum(F.col("n") * F.col("mean")).over(Window.partitionBy("feature")) / F.sum("n").over(
        Window.partitionBy("feature"))
    shift = F.col("mean") - F.col("grand")
    sums = groups.withColumn("grand", grand).groupBy("feature").agg(
        F.sum(F.col("n") * shift * shift).alias("between"), F.sum(F.col("n") * F.col("var")).alias("within"),
        F.count("*").alias("k"), F.sum("n").alias("n"))
    score = (F.col("between") / F.nullif(F.col("k") - 1, F.lit(0))) / F.nullif(
        F.col("within") / F.nullif(F.col("n") - F.col("k"), F.lit(0.0)), F.lit(0.0))
    return sums.select("feature", score.alias("f_score"))


def top_features(scores: DataFrame, score: str, n: int = 10) -> DataFrame:
    """The n best features; equal scores by name."""
    return first_rows(scores, [F.col(score).desc_nulls_last(), F.col("feature")], n)


def select_k_best(df: DataFrame, features: Sequence[str], label: str, k: int = 10,
                  train: Column | None = None) -> DataFrame:
    return top_features(anova_f(df if train is None else df.filter(train), features, label), "f_score", k)


def keep_selected(df: DataFrame, features: Sequence[str], chosen: DataFrame) -> DataFrame:
    """``df`` without the features that a selection fitted elsewhere left out; it has at most a row per feature."""
    stay = {r["feature"] for r in chosen.select("feature").collect()}
    return df.drop(*[c for c in features if c not in stay])


def correlations(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> list[tuple[str, str, float | None]]:
    """``(a, b, corr)`` of a left and a right column each, from one pass; None where a column does not vary."""
    found = gram.correlations(df, left, right)
    return [(a, b, None if math.isnan(x) else x) for a, row in zip(left, found.tolist()) for b, x in zip(right, row)]


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, corr)`` for every two columns, the one named first as ``a``."""
    place = {c: i for i, c in enumerate(columns)}
    rows = [r for r in correlations(df, columns, columns) if place[r[0]] < place[r[1]]]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")


def proxies(df: DataFrame, protected: Sequence[str], others: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """Columns (already encoded) that correlate with a protected one beyond the threshold."""
    found = df.sparkSession.createDataFrame(correlations(df, protected, others), "a string, b string, corr double")
    strongest = found.groupBy(F.col("b").alias("feature")).agg(F.max(F.abs("corr")).alias("strongest"))
    return strongest.withColumn("proxy", F.coalesce(F.col("strongest") > F.lit(float(threshold)), F.lit(False)))


def permutation_importance(df: DataFrame, key: str, label: str, features: Sequence[str],
                           predict: Callable[[Mapping[str, Column]], Column], repeats: int = 10, seed=42) -> DataFrame:
    """``(feature, importance)``: mean loss of accuracy when one feature is permuted.

    In each repeat the rows form one ring in digest order, and each row takes the feature of the next one. The rows are cut
    into sorted slices; the last row of a slice takes the first values of the next slice, of which there are as many
    as slices. All features and repeats share one shuffle, in which a row is its digest in 16 bytes, its label and its features.
    """
    runs = settle(
        df.select(key, label, *features, F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("__run"))
        .withColumn("__h", F.unhex(digest(seed, key, "__run")))
        .select("__run", "__h", *dict.fromkeys([label, *features]))
        .repartitionByRange("__run", "__h")
        .withColumn("__slice", F.spark_partition_id()))
    values = F.struct(*[F.col(c) for c in features])
    ring = Window.partitionBy("__slice", "__run").orderBy("__h")
    firsts = runs.groupBy("__run", "__slice").agg(F.min_by(values, "__h").alias("__first"))
    around = Window.partitionBy("__run").orderBy("__slice")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select(F.col("__run").alias("__of"), F.col("__slice").alias("__at"), F.coalesce(
        F.lead("__first").over(around), F.first("__first").over(whole)).alias("__next"))  # a row per slice and repeat
    runs = runs.withColumn("__inside", F.lead(values).over(ring)).join(
        F.broadcast(following), (F.col("__run") == F.col("__of")) & (F.col("__slice") == F.col("__at")))
    runs = runs.withColumn("__other", F.coalesce("__inside", "__next"))
    own = {c: F.col(c) for c in features}

    def right(given):
        return predict(given).eqNullSafe(F.col(label)).cast("double")
    losses = runs.agg(*[F.avg(right(own) - right({**own, c: F.col(f"__other.{c}")})).alias(c) for c in features])
    rows = stacked(*[{"feature": c, "importance": F.col(c)} for c in features])
    return losses.select(F.inline(rows))


def drop_proxies(df: DataFrame, protected: Sequence[str], found: DataFrame) -> DataFrame:
    """Remove protected columns and every flagged proxy; there is at most one row per column of the frame."""
    flagged = [r["feature"] for r in found.filter("proxy").collect()]
    return df.drop(*protected, *flagged)

