"""Projection, filtering and scalar cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepaudit.functions.text import strip
from prepaudit.operators.distributed import attach, names


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def require_columns(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Fail before any job when a column is missing."""
    missing = [c for c in names(columns) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def strip_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({c: strip(F.col(c)) for c in columns or string_columns(df)})


def placeholders_to_null(df: DataFrame, placeholders: Sequence[str],
                         columns: Sequence[str] | None = None) -> DataFrame:
    """Strip the string columns and turn every placeholder into null."""
    def clean(c):
        bare = strip(F.col(c))
        return F.when(~bare.isin(list(placeholders)), bare)
    return df.withColumns({c: clean(c) for c in columns or string_columns(df)})


def differs(column: Column, value) -> Column:
    """``!=`` that keeps nulls."""
    return ~column.eqNullSafe(F.lit(value))


def keep_rows(df: DataFrame, *conditions: Column) -> DataFrame:
    """All conditions at once; they become one filter and reach the scan."""
    for condition in conditions:
        df = df.filter(condition)
    return df


def recode(df: DataFrame, old, new, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace a value in the named columns, or in the whole frame."""
    return df.replace(old, new, subset=list(columns) if columns else None)


def normalise_text(column: Column, replacements: Mapping[str, str] | None = None) -> Column:
    """Strip, lower-case and replace literal characters."""
    column = F.lower(strip(column))
    for old, new in (replacements or {"-": " "}).items():
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def collapse(column: Column, members: Sequence[str], label: str) -> Column:
    """Give listed categories one label and keep the others."""
    return F.when(column.isin(list(members)), F.lit(label)).otherwise(column)


def keep_listed(column: Column, common: Sequence[str], label: str = "Rare") -> Column:
    """Keep listed values and give the others one label."""
    return F.when(column.isin(list(common)), column).otherwise(F.lit(label))


def keep_frequent(df: DataFrame, column: str, at_least: int, label: str = "Rare") -> DataFrame:
    """Give values seen fewer than ``at_least`` times one label."""
    counts = df.groupBy(column).agg(F.count("*").alias("__n"))
    kept = F.when(F.col("__n") >= at_least, F.col(column)).otherwise(F.lit(label))
    return attach(df, counts, column).withColumn(column, kept).drop("__n")


def generalise(df: DataFrame, columns: Sequence[str], at_least: int, label: str = "anon") -> DataFrame:
    """Replace identifying (rare) values of each column by one label."""
    for c in columns:
        df = keep_frequent(df, c, at_least, label)
    return df


def group_sizes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per combination of quasi-identifiers: the k of k-anonymity is the minimum."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def indicator(column: Column, value) -> Column:
    """1 where the value is met, 0 elsewhere and for null."""
    return F.coalesce((column == F.lit(value)).cast("int"), F.lit(0))


def map_values(column: Column, mapping: Mapping) -> Column:
    """Look a value up; an unmapped one becomes null, so that an empty mapping gives nulls only."""
    if not mapping:
        return F.lit(None)
    (first_key, first_value), *rest = mapping.items()
    found = F.when(column == F.lit(first_key), F.lit(first_value))
    for key, value in rest:
        found = found.when(column == F.lit(key), F.lit(value))
    return found


def present(column: Column) -> Column:
    return column.isNotNull().cast("int")


def fixed_bins(column: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-open bins ``[edge, next)``; a value outside all of them becomes null."""
    if len(edges) != len(labels) + 1:
        raise ValueError("one label per bin")
    found = F.when((column >= edges[0]) & (column < edges[1]), F.lit(labels[0]))
    for low, high, label in zip(edges[1:], edges[2:], labels[1:]):
        found = found.when((column >= low) & (column < high), F.lit(label))
    return found


def duration_days(start: Column, end: Column) -> Column:
    """Whole days between two timestamps, rounded down; clock changes count only for timestamps with a zone."""
    gap = end - start
    parts = {"DAY": 86_400, "HOUR": 3_600, "MINUTE": 60, "SECOND": 1}
    seconds = sum((F.extract(F.lit(unit), gap).cast("double") * F.lit(float(size)) for unit, size in parts.items()),
                  F.lit(0.0))
    return F.floor(seconds / F.lit(86_400.0)).cast("double")


class DurationDays(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``duration_days`` as a pipeline stage; drops the two source columns.

    Text is read leniently: what is no timestamp becomes null, and so does the duration.
    """

    startCol = Param(Params._dummy(), "startCol", "start column", TypeConverters.toString)
    endCol = Param(Params._dummy(), "endCol", "end column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "output column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, startCol=None, endCol=None, outputCol=None):
        super().__init__()
        self._setDefault(outputCol="duration_days")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        start, end = self.getOrDefault(self.startCol), self.getOrDefault(self.endCol)
        text = set(string_columns(df))
        instants = [F.col(c).try_cast("timestamp_ntz") if c in text else F.col(c) for c in (start, end)]
        days = duration_days(*instants)
        return df.withColumn(self.getOrDefault(self.outputCol), days).drop(start, end)


def token_between(column: Column, after: str, before: str) -> Column:
    """The stripped text between the first ``after`` and the next ``before``; null when ``after`` is missing."""
    rest = F.get(F.split(column, f"\\Q{after}\\E"), F.lit(1))
    return strip(F.get(F.split(rest, f"\\Q{before}\\E"), F.lit(0)))


def first_rows(df: DataFrame, order: Sequence, n: int = 5) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)
