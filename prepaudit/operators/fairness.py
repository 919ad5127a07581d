"""Group fairness of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fairness_metrics(df: DataFrame, y: str, p: str, group: str, privileged, unprivileged: Sequence) -> DataFrame:
    """Disparate impact, average odds difference and equal opportunity difference in one pass."""
    sides = {"u": F.col(group).isin(list(unprivileged)), "v": F.col(group) == F.lit(privileged)}
    yes, said = F.col(y) == 1, F.col(p) == 1

    def rate(top: Column, base: Column) -> Column:
        return F.count_if(top & base) / F.nullif(F.count_if(base).cast("double"), F.lit(0.0))
    rates = df.agg(*[x for s, on in sides.items() for x in (
        rate(said, on).alias(f"said_{s}"), rate(said, on & yes).alias(f"tpr_{s}"), rate(said, on & ~yes).alias(f"fpr_{s}"))])
    tpr = F.col("tpr_u") - F.col("tpr_v")
    return rates.select(
        (F.col("said_u") / F.nullif(F.col("said_v"), F.lit(0.0))).alias("disparate_impact"),
        (F.lit(0.5) * (F.col("fpr_u") - F.col("fpr_v") + tpr)).alias("average_odds_difference"),
        tpr.alias("equal_opportunity_difference"))


def parity_gap(df: DataFrame, p: str, group: str) -> DataFrame:
    """Largest difference between groups in the share predicted 1."""
    rates = df.groupBy(group).agg(F.avg((F.col(p) == 1).cast("double")).alias("rate"))
    return rates.agg((F.max("rate") - F.min("rate")).alias("parity_gap"))
