"""Profiling: shares, nulls, summaries, drift and loss of detail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepaudit.functions.rows import stacked
from prepaudit.operators.clean import numeric_columns
from prepaudit.operators.distributed import attach, quantiles, scalars, settle


def group_counts(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Rows per value, nulls included."""
    return df.groupBy(*([columns] if isinstance(columns, str) else columns)).agg(F.count("*").alias("n"))


def value_shares(df: DataFrame, column: str, digits: int | None = 2, by: Sequence[str] = ()) -> DataFrame:
    """Share of each value among the non-null ones, halves rounded to even."""
    held = df.filter(F.col(column).isNotNull())
    counted = settle(held.groupBy(*by, column).agg(F.count("*").alias("n")))  # the rows are read once
    totals = counted.groupBy(*by).agg(F.sum("n").alias("__total"))
    if by:
        counted = attach(counted, totals, by)
    else:
        counted = counted.withColumn("__total", scalars(totals)["__total"])
    share = F.col("n").cast("double") / F.col("__total")
    if digits is not None:
        share = F.rint(share * F.lit(10.0**digits)) / F.lit(10.0**digits)
    return counted.withColumn("share", share).drop("__total")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., feature, nulls, any_null)`` from one pass."""
    columns = [c for c in columns or df.columns if c not in by]
    counted = df.groupBy(*by).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    cells = stacked(*[{"feature": c, "nulls": F.col(c)} for c in columns])
    return counted.select(*by, F.inline(cells)).withColumn("any_null", F.col("nulls") > 0)


def describe_by(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample sd, min, exact quartiles and max per numeric column."""
    columns = list(columns or [c for c in numeric_columns(df) if c not in by])
    moments = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.groupBy(*by).agg(*[f(F.col(c).cast("double")).alias(f"{c}__{m}") for c in columns
                                 for m, f in moments.items()])
    cells = stacked(*[{"feature": c, **{m: F.col(f"{c}__{m}") for m in moments}} for c in columns])
    long = wide.select(*by, F.inline(cells))
    edges = quantiles(df, columns, [0.25, 0.5, 0.75], by).drop("n")
    joined = attach(long, edges, [*by, "feature"], "left")
    return joined.select(*by, "feature", "count", "mean", "std", "min", F.col("q0").alias("q25"),
                         F.col("q1").alias("q50"), F.col("q2").alias("q75"), "max")


def info(df: DataFrame) -> DataFrame:
    """``(feature, type, non_null)`` per column in one pass."""
    counted = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return counted.select(F.inline(stacked(*[{"feature": c, "type": t, "non_null": F.col(c)} for c, t in df.dtypes])))


def shape(df: DataFrame) -> DataFrame:
    """One row: rows and columns."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def imbalance(df: DataFrame, label: str, threshold: float = 0.2) -> DataFrame:
    """One row: the smallest class share and whether it lies below the threshold."""
    shares = value_shares(df, label, None)
    return shares.agg(F.count("*").alias("classes"), F.min("share").alias("min_share"),
                      (F.min("share") < F.lit(float(threshold))).alias("imbalanced"))


def share_drift(df: DataFrame, column: str, split: str, before: str, after: str) -> DataFrame:
    """Share of every value on two sides of a split and the difference; a value missing on one side counts 0."""
    held = df.filter(F.col(column).isNotNull() & F.col(split).isin(before, after))
    sides = [F.count_if(F.col(split) == side).alias(name) for name, side in (("__b", before), ("__a", after))]
    counted = settle(held.groupBy(column).agg(*sides))  # the rows are read once
    total = scalars(counted.agg(F.sum("__b").alias("__b"), F.sum("__a").alias("__a")))

    def share(c):
        return F.col(c).cast("double") / F.nullif(total[c], F.lit(0))
    return counted.select(
        column, share("__b").alias("share_before"), share("__a").alias("share_after")).withColumn(
        "drift", F.col("share_after") - F.col("share_before"))


def granularity(df: DataFrame, before: str, after: str) -> DataFrame:
    """Distinct values and entropy before and after a rollup; rows are counted once per pair of values."""
    pairs = df.groupBy(before, after).agg(F.count("*").alias("n"))
    sides = stacked(*[{"side": side, "value": F.col(c).cast("string")} for side, c in (("before", before), ("after", after))])
    counted = pairs.select("n", F.inline(sides)).filter(F.col("value").isNotNull()).groupBy("side", "value").agg(
        F.sum("n").cast("double").alias("n"))
    n = F.col("n")
    entropy = F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)
    return counted.groupBy("side").agg(F.count("*").alias("distinct_values"), entropy.alias("entropy"))
