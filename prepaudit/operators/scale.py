"""Scaling numbers. Fits are one row and reach the rows as scalar subqueries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepaudit.operators.distributed import quantiles, scalars, settle


def _nonzero(width: Column) -> Column:
    """A feature without spread is left at its centre, not divided by zero."""
    return F.when(width == 0, F.lit(1.0)).otherwise(width)


def fit_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation."""
    return df.agg(*[F.avg(c).alias(f"{c}__centre") for c in columns],
                  *[F.stddev_pop(c).alias(f"{c}__width") for c in columns])


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.min(c).cast("double").alias(f"{c}__centre") for c in columns],
                  *[(F.max(c) - F.min(c)).cast("double").alias(f"{c}__width") for c in columns])


def fit_robust(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median and interquartile range."""
    found = quantiles(df, columns, [0.25, 0.5, 0.75])

    def of(c, value):
        return F.max(F.when(F.col("feature") == c, value))
    return found.agg(*[of(c, F.col("q1")).alias(f"{c}__centre") for c in columns],
                     *[of(c, F.col("q2") - F.col("q0")).alias(f"{c}__width") for c in columns])


FITS = {"standard": fit_standard, "minmax": fit_minmax, "robust": fit_robust}


def scale(df: DataFrame, columns: Sequence[str], method: str = "standard",
          train: Column | None = None) -> DataFrame:
    """``(x - centre) / width`` with both fitted on the rows where ``train`` holds."""
    fitted = df if train is None else df.filter(train)
    fit = scalars(settle(FITS[method](fitted, columns)))
    return df.withColumns({c: (F.col(c) - fit[f"{c}__centre"]) / _nonzero(fit[f"{c}__width"]) for c in columns})


def normalise_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide the columns of a row by their L2 norm; an all-zero row stays as it is."""
    squares = sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    return df.withColumns({c: F.col(c) / _nonzero(F.sqrt(squares)) for c in columns})


def normalise_vector(column: Column) -> Column:
    """The same for an array column."""
    wide = F.transform(column, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda total, x: total + x * x))
    return F.transform(wide, lambda x: x / _nonzero(norm))
