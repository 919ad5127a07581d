"""Corpora of cases: one text per case and role, in a long frame ``(case, role, text)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepaudit.functions.text import strip_comment_lines


def complete_cases(texts: DataFrame, roles: Sequence[str], case: str = "case", order: str | None = None) -> DataFrame:
    """One row per case that has every role, a column per role.

    Where a role occurs several times the first by ``order`` counts. One
    grouped aggregation stands for one inner join per role.
    """
    pick = F.col(order) if order else F.lit(0)

    def one(role):
        held = F.col("role") == F.lit(role)
        return F.min_by(F.when(held, F.col("text")), F.when(held, pick)).alias(role)
    wide = texts.filter(F.col("role").isin(list(roles))).groupBy(case).agg(*[one(r) for r in roles])
    return wide.na.drop("any", subset=list(roles))


def pending_cases(inputs: DataFrame, outputs: DataFrame, case: str = "case", text: str = "text") -> DataFrame:
    """Inputs whose case has no output yet, comment lines removed."""
    done = outputs.select(case).distinct()
    return inputs.join(done, case, "left_anti").withColumn(text, strip_comment_lines(F.col(text)))


def excluding(texts: DataFrame, *name_parts: str, column: str = "file") -> DataFrame:
    """Leave out derived files by parts of their name."""
    keep: Column = F.lit(True)
    for part in name_parts:
        keep = keep & ~F.contains(F.col(column), F.lit(part))
    return texts.filter(keep)
