"""Filling nulls. A fit is one row of fill values; applying it moves no rows."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepaudit.operators import gram
from prepaudit.operators.clean import numeric_columns, string_columns
from prepaudit.operators.distributed import one_row, quantiles, scalars, settle, value_counts


def fit_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def fit_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact medians; the midpoint where two values share the middle."""
    found = quantiles(df, columns, [0.5])
    return found.agg(*[F.max(F.when(F.col("feature") == c, F.col("q0"))).alias(c) for c in columns])


def fit_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value; the smallest on a tie."""
    types = {name: kind for name, kind in df.dtypes if name in columns}
    best = {}
    for kind in sorted(set(types.values())):
        chosen = [c for c in columns if types[c] == kind]
        order = F.struct((-F.col("n")).alias("rank"), F.col("value").alias("value"))
        modes = value_counts(df, chosen, kind=kind).agg(
            *[F.min(F.when(F.col("feature") == c, order)).getField("value").alias(c) for c in chosen])
        best.update(scalars(modes))
    return one_row(df, **{c: best[c] for c in columns})


def fit_fills(df: DataFrame, strategies: Mapping[str, str | tuple]) -> DataFrame:
    """One row of fill values. A strategy is ``mean``, ``median``, ``mode`` or ``("constant", value)``."""
    fits = {"mean": fit_mean, "median": fit_median, "mode": fit_mode}
    values: dict[str, Column] = {}
    for strategy, fit in fits.items():
        columns = [c for c, s in strategies.items() if s == strategy]
        if columns:
            values.update(scalars(fit(df, columns)))
    for c, s in strategies.items():
        if isinstance(s, tuple):
            values[c] = F.lit(s[1])
    unknown = set(strategies) - set(values)
    if unknown:
        raise ValueError(f"unknown strategy for {sorted(unknown)}")
    return settle(one_row(df, **{c: values[c] for c in strategies}))


def apply_fills(df: DataFrame, fills: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in scalars(fills).items()})


def impute(df: DataFrame, strategies: Mapping[str, str | tuple], train: Column | None = None) -> DataFrame:
    """Fit on the rows where ``train`` holds and fill every row."""
    fitted = df if train is None else df.filter(train)
    return apply_fills(df, fit_fills(fitted, strategies))


def by_type(df: DataFrame, columns: Sequence[str] | None = None,
            number: str | tuple = "mean", text: str | tuple = "mode") -> dict:
    """A strategy per column from its type."""
    wanted = columns or df.columns
    chosen = {c: number for c in numeric_columns(df) if c in wanted}
    chosen.update({c: text for c in string_columns(df) if c in wanted})
    return {c: chosen[c] for c in wanted if c in chosen}


def impute_regression(df: DataFrame, columns: Sequence[str], rounds: int = 10, train: Column | None = None,
                      tolerance: float = 1e-3) -> DataFrame:
    """Fill each column from a Bayesian ridge regression on the others, in turn, until values settle or ``rounds`` are over.

    Fits use the rows where the column is known (and ``train`` holds), with the other columns as filled so far, from their means on; columns with fewer
    nulls come first. Rounds end when filled values move by less than ``tolerance`` of their column's deviation, in the root of the mean square.
    A column without any known value stays null. While the patterns of nulls are not too many, one scan serves all rounds.
    """
    chain, order, maps = gram.fit_chain(df, columns, rounds, tolerance, train)
    if not order:
        return df
    if maps:
        known = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns]
        bits = functools.reduce(lambda a, b: a + b, [
            F.when(F.col(f"`{c}`").isNull(), F.lit(1 << j)).otherwise(F.lit(0)).cast("bigint") for j, c in enumerate(columns)])

        def filled(j: int) -> Column:
            out = F.lit(None).cast("double")
            for name, m in maps.items():
                if name >> j & 1:
                    value = F.lit(float(m[j, -1]))
                    for i, x in enumerate(known):
                        if m[j, i]:
                            value = value + F.lit(float(m[j, i])) * x
                    out = F.when(bits == name, value).otherwise(out)
            return out
        values = {j: filled(j) for j in order}
    else:
        kinds = ", ".join(f"v{j} double" for j in order)

        @F.pandas_udf(kinds)
        def replay(*given: pd.Series) -> pd.DataFrame:
            x = np.stack([g.to_numpy(dtype=float) for g in given], 1)
            known = ~np.isnan(x)
            found = chain.fill(np.where(known, x, 0.0), known.astype(float))
            return pd.DataFrame({f"v{j}": found[:, j] for j in order})
        told = replay(*[F.col(f"`{c}`").cast("double") for c in columns])
        values = {j: told.getField(f"v{j}") for j in order}
    return df.withColumns({columns[j]: F.coalesce(F.col(f"`{columns[j]}`").cast("double"), v) for j, v in values.items()})
