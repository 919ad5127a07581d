"""Encoding categories and numbers as features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepaudit.operators.distributed import attach, quantiles, running_total, scalars
from prepaudit.operators.impute import impute
from prepaudit.operators.scale import scale


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """``(column, code)``: rank among the sorted distinct values, from 0."""
    values = df.filter(F.col(column).isNotNull()).select(column).distinct()
    ranked = running_total(values, [], [column], code=F.lit(1).cast("bigint"))
    return ranked.select(column, (F.col("code") - 1).alias("code"))


def label_encode(df: DataFrame, column: str, codes: DataFrame, output: str) -> DataFrame:
    """Attach codes; a value the codes do not know is an error."""
    unseen = F.raise_error(F.concat(F.lit(f"unseen value in {column}: "), F.coalesce(F.col(column), F.lit("null"))))
    code = F.when(F.col("code").isNull(), unseen.cast("bigint")).otherwise(F.col("code"))
    return attach(df, codes, column, "left").withColumn(output, code).drop("code" if output != "code" else "")


def ordinal_encode(df: DataFrame, column: str, codes: DataFrame, output: str, unknown: int = -1) -> DataFrame:
    """Attach codes; a value the codes do not know becomes ``unknown``."""
    code = F.coalesce(F.col("code"), F.lit(unknown).cast("bigint"))
    return attach(df, codes, column, "left").withColumn(output, code).drop("code" if output != "code" else "")


#: A category column with more values than this is not spread over columns.
WIDEST = 4096


def category_lists(df: DataFrame, columns: Sequence[str], widest: int | None = None) -> dict[str, list | None]:
    """Sorted distinct values of every column, None for one that has more than ``widest``; from two jobs for any number of columns.

    Values are collected only where a sketch finds few, so the driver never holds more than a table has columns.
    """
    widest = WIDEST if widest is None else widest
    if not columns:
        return {}
    told = df.agg(*[F.approx_count_distinct(c, 0.02).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    few = [c for i, c in enumerate(columns) if told[f"n{i}"] <= 1.2 * widest]
    found = df.agg(*[F.collect_set(c).alias(f"v{i}") for i, c in enumerate(few)]).first() if few else []
    lists = {c: sorted(values) for c, values in zip(few, found)}
    return {c: lists[c] if c in lists and len(lists[c]) <= widest else None for c in columns}


def categories(df: DataFrame, column: str, widest: int | None = None) -> list:
    """Sorted distinct values, for encoders that make each of them a column; an error where they are more than ``widest``.

    Where categories grow with the rows, ``one_hot_sparse`` keeps them in a table.
    """
    found = category_lists(df, [column], widest)[column]
    if found is None:
        raise ValueError(f"{column} has more than {WIDEST if widest is None else widest} values: encode it by one_hot_sparse")
    return found


def one_hot_sparse(df: DataFrame, column: str, codes: DataFrame, output: str) -> DataFrame:
    """One-hot rows of any width: ``output`` is the place of the row's 1, null (all zeros) for an unknown value or null.

    ``codes`` comes from ``label_codes`` of the fitted rows, and its size is the width.
    """
    known = codes.select(column, F.col("code").alias("__place"))
    return attach(df, known, column, "left").withColumn(output, F.col("__place")).drop("__place")


def indicator_name(column: str, value) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in f"{column}_{value}")


def one_hot(df: DataFrame, column: str, values: Sequence, drop_first: bool = False, keep: bool = False) -> DataFrame:
    """One 0/1 column per known category; an unknown value or null is all zeros."""
    used = list(values)[1:] if drop_first else list(values)
    columns = {indicator_name(column, v): F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in used}
    df = df.withColumns(columns) if columns else df
    return df if keep else df.drop(column)


def dummies(df: DataFrame, columns: Sequence[str], drop_first: bool = False) -> DataFrame:
    """Indicators from the categories that this frame itself holds."""
    found = category_lists(df, columns)
    for c in columns:
        if found[c] is None:
            raise ValueError(f"{c} has more than {WIDEST} values: encode it by one_hot_sparse")
        df = one_hot(df, c, found[c], drop_first)
    return df


def align_columns(df: DataFrame, like: Sequence[str], fill=0) -> DataFrame:
    """The columns of ``like`` in its order: missing ones are filled, extra ones dropped."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in like])


def binarise(column: Column, classes: Sequence) -> Column:
    """1 for the second of two classes, 0 for anything else."""
    return F.coalesce((column == F.lit(classes[1])).cast("int"), F.lit(0))


def uniform_bins(df: DataFrame, column: str, bins: int, output: str, train: Column | None = None) -> DataFrame:
    """Equal-width bin numbers 0..bins-1 between the fitted minimum and maximum."""
    fitted = df if train is None else df.filter(train)
    edge = scalars(fitted.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")))
    width = edge["hi"] - edge["lo"]
    at = F.when(width == 0, F.lit(0.0)).otherwise(
        F.floor((F.col(column) - edge["lo"]) / F.when(width != 0, width) * F.lit(float(bins))))
    inside = F.greatest(F.lit(0.0), F.least(F.lit(float(bins - 1)), at.cast("double")))
    return df.withColumn(output, inside.cast("int"))


def quantile_bins(df: DataFrame, column: str, bins: int, output: str, train: Column | None = None) -> DataFrame:
    """Bin numbers between fitted quantiles; a value on an edge belongs to the upper bin."""
    fitted = df if train is None else df.filter(train)
    inner = [i / bins for i in range(1, bins)]
    edges = scalars(quantiles(fitted, [column], inner).select(*[f"q{i}" for i in range(bins - 1)]))
    number = sum(((F.col(column) >= edge).cast("int") for edge in edges.values()), F.lit(0))
    return df.withColumn(output, number)


@dataclass
class Features:
    """What to do with each group of columns; the others are dropped or passed through."""

    numeric: Sequence[str] = ()
    categorical: Sequence[str] = ()
    fill_numeric: str | tuple = "mean"
    fill_categorical: str | tuple = "mode"
    scaler: str | None = "standard"
    drop_first: bool = False
    remainder: str = "drop"
    keep: Sequence[str] = field(default_factory=list)
    widest: int = WIDEST


def featurise(df: DataFrame, spec: Features, train: Column | None = None) -> DataFrame:
    """Impute, scale and encode by column group, everything fitted on the train rows only.

    A category column with more than ``widest`` values becomes one column, ``<column>__place``: the place of the row's 1 among
    the sorted values, null for an unknown one.
    """
    fills: Mapping = {**{c: spec.fill_numeric for c in spec.numeric},
                      **{c: spec.fill_categorical for c in spec.categorical}}
    filled = impute(df, fills, train)
    scaled = scale(filled, spec.numeric, spec.scaler, train) if spec.scaler else filled
    known = scaled if train is None else scaled.filter(train)
    out = scaled
    made, lists = [], category_lists(known, spec.categorical, spec.widest)
    for c in spec.categorical:
        before = set(out.columns)
        if lists[c] is None:
            out = one_hot_sparse(out, c, label_codes(known, c), f"{c}__place").drop(c)
        else:
            out = one_hot(out, c, lists[c], spec.drop_first)
        made += [x for x in out.columns if x not in before]
    if spec.remainder == "passthrough":
        return out
    return out.select(*spec.keep, *spec.numeric, *made)
