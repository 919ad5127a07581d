"""Sample weights from group and class counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepaudit.operators.distributed import attach, scalars, settle


def _counts(df: DataFrame, *by: str) -> DataFrame:
    """Counted once; the totals below come from this table, not from the rows."""
    return settle(df.groupBy(*by).agg(F.count("*").cast("double").alias("__n")))


def _facts(cells: DataFrame) -> dict[str, Column]:
    return scalars(cells.agg(F.sum("__n").alias("total"), F.count("*").alias("cells")))


def reweighing(df: DataFrame, group: str, label: str, output: str = "weight") -> DataFrame:
    """n_group * n_label / (n * n_group_label): makes the label independent of the group."""
    cells = _counts(df, group, label)
    for side, name in ((group, "__group"), (label, "__label")):
        cells = attach(cells, cells.groupBy(side).agg(F.sum("__n").alias(name)), side)
    weight = F.col("__group") * F.col("__label") / (_facts(cells)["total"] * F.col("__n"))
    return attach(df, cells.select(group, label, weight.alias(output)), [group, label])


def class_weights(df: DataFrame, label: str, output: str = "weight") -> DataFrame:
    """n / (classes * n_class)."""
    cells = _counts(df, label)
    facts = _facts(cells)
    weight = facts["total"] / (facts["cells"] * F.col("__n"))
    return attach(df, cells.select(label, weight.alias(output)), label)


def share_weights(df: DataFrame, label: str, output: str = "weight") -> DataFrame:
    """The share of the row's own class."""
    cells = _counts(df, label)
    return attach(df, cells.select(label, (F.col("__n") / _facts(cells)["total"]).alias(output)), label)


def importance_weights(df: DataFrame, label: str, train: Column, output: str = "weight") -> DataFrame:
    """Per train row, the share of its label in all rows over its share in the train rows."""
    cells = settle(df.groupBy(label).agg(F.count("*").cast("double").alias("__n"),
                                         F.count_if(train).cast("double").alias("__t")))
    total = scalars(cells.agg(F.sum("__n").alias("n"), F.sum("__t").alias("t")))
    ratio = (F.col("__n") / total["n"]) / F.nullif(F.col("__t") / total["t"], F.lit(0.0))
    return attach(df.filter(train), cells.select(label, ratio.alias(output)), label)
