"""Splitting, sampling and resampling, all reproducible from a key and a seed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepaudit.functions.hashing import below, draw, fine_uniform, gaussian, uniform
from prepaudit.functions.rows import stacked
from prepaudit.operators.distributed import attach, hash_cutoffs, hash_place, repeat_rows, running_total, scalars, settle
from prepaudit.operators.neighbours import nearest


def hash_split(df: DataFrame, key: str, train_share: float = 0.8, seed=42, output: str = "split") -> DataFrame:
    """Random split: a projection, no shuffle."""
    side = F.when(below(seed, train_share, key), F.lit("train")).otherwise(F.lit("test"))
    return df.withColumn(output, side)


def stratified_split(df: DataFrame, key: str, label: str, train_share: float = 0.8, seed=42,
                     output: str = "split") -> DataFrame:
    """In each class the first ``ceil(share * n)`` rows in hash order are train."""
    cuts = hash_cutoffs(df, key, [label], seed, __cut=F.ceil(F.lit(train_share) * F.col("n")))
    side = F.when(hash_place(key, seed) <= F.col("__cut"), F.lit("train")).otherwise(F.lit("test"))
    return attach(df, cuts, label, "left").withColumn(output, side).drop("__cut")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, seed=42,
                     output: str = "fold") -> DataFrame:
    """Cut each class's hash order into ``folds`` runs whose sizes differ by at most one row."""
    n, k = F.col("n"), F.lit(folds)
    ends = {f"__end{i}": F.lit(i) * F.floor(n / k) + F.least(F.lit(i), n % k) for i in range(1, folds)}
    cuts = hash_cutoffs(df, key, [label], seed, **ends)
    later = sum(((F.col("__place") > F.col(end)).cast("int") for end in ends), F.lit(0))
    placed = attach(df, cuts, label, "left").withColumn("__place", hash_place(key, seed))
    return placed.withColumn(output, later).drop(*ends, "__place")


def sample_by_class(df: DataFrame, key: str, label: str, shares: Mapping, seed=42) -> DataFrame:
    """Keep a share of the rows of each listed class and every row of the others."""
    keep = F.lit(True)
    for value, share in shares.items():
        keep = F.when(F.col(label) == F.lit(value), below(seed, share, key)).otherwise(keep)
    return df.filter(keep)


def undersample(df: DataFrame, key: str, label: str, seed=42) -> DataFrame:
    """Without replacement, as many rows of each class as the smallest class has."""
    counts = df.groupBy(label).agg(F.count("*").alias("c"))
    smallest = scalars(counts.agg(F.min("c").alias("m")))["m"]
    cuts = hash_cutoffs(df.withColumn("__take", smallest), key, [label, "__take"], seed, __cut=F.col("__take"))
    cuts = cuts.drop("__take")
    return attach(df, cuts, label).filter(hash_place(key, seed) <= F.col("__cut")).drop("__cut")


def add_noise(df: DataFrame, key: str, columns: Sequence[str], sigma: float, seed=42,
              suffix: str = "") -> DataFrame:
    """Gaussian noise drawn per key and column."""
    return df.withColumns(
        {f"{c}{suffix}": F.col(c) + F.lit(float(sigma)) * gaussian(f"{seed}/{c}", key) for c in columns})


def bootstrap(df: DataFrame, key: str, weight: str, by: Sequence[str] = (), seed=42) -> DataFrame:
    """Weighted resample with replacement; every ``by`` group keeps its number of rows.

    ``weight`` is a non-negative number, whole or not; it counts to twelve decimal places, in exact sums. The weights of
    a group are laid end to end in key order; each row also throws one dart at that line and a row is repeated
    once per dart in its interval. Darts and interval ends are counted together
    in one sorted running total, so there is no range join. Adds ``copy``.
    """
    by = list(by)
    exact = F.coalesce(F.col(weight).cast("decimal(26,12)"), F.lit(0).cast("decimal(26,12)"))
    laid = running_total(df.select(*by, key, exact.alias("w")), by, [key], upto="w")
    line = laid.groupBy(*by).agg(F.max("upto").alias("length"))
    thrown = attach(laid, line, by) if by else laid.withColumn("length", scalars(line)["length"])
    at = fine_uniform(seed, key) * F.col("length").cast("double")
    low, high = (F.col("upto") - F.col("w")).cast("double"), F.col("upto").cast("double")
    point = stacked({"kind": 1, "at": at, "dart": 1}, {"kind": 0, "at": low, "dart": 0}, {"kind": 2, "at": high, "dart": 0})
    points = thrown.select(*by, key, F.inline(point)).withColumn(
        "__after", F.when(F.col("kind") == 1, 1).otherwise(0))
    counted = running_total(points, by, ["at", "__after", "kind", key], darts="dart")
    hits = counted.filter(F.col("kind") != 1).groupBy(*by, key).agg(
        (F.max(F.when(F.col("kind") == 2, F.col("darts"))) - F.max(F.when(F.col("kind") == 0, F.col("darts"))))
        .alias("hits"))
    hits = settle(hits.filter(F.col("hits") > 0).select(F.col(key).alias("__key"), "hits"))
    return repeat_rows(df.join(hits, df[key] == hits["__key"]).drop("__key"), "hits", "copy", [key]).drop("hits")


def smote(df: DataFrame, key: str, vector: str, label: str, k: int = 5, seed=42) -> DataFrame:
    """Synthetic rows that raise the smallest class to the size of the largest.

    A synthetic row lies on the segment from a minority row to one of its k nearest
    minority rows. Returns the synthetic rows only:
    ``(key, copy, neighbour, label, vector)``.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    facts = sizes.agg(
        F.min(F.struct("n", label)).alias("small"), F.max("n").alias("big")).select(
        F.col(f"small.{label}").alias("minority"), F.col("small.n").alias("have"),
        (F.col("big") - F.col("small.n")).alias("need"))
    fit = scalars(facts)
    minority = df.filter(F.col(label) == fit["minority"]).select(key, vector, label)
    extra = fit["need"] % fit["have"]
    cuts = hash_cutoffs(minority.withColumn("__extra", extra), key, [label, "__extra"], seed,
                        __cut=F.col("__extra")).drop("__extra")
    one_more = F.coalesce((hash_place(key, seed) <= F.col("__cut")).cast("int"), F.lit(0))
    quota = F.floor(fit["need"] / fit["have"]) + one_more
    numbered = attach(minority, cuts, label, "left").withColumn("__quota", quota).drop("__cut")
    copies = repeat_rows(settle(numbered.select(key, vector, label, "__quota")), "__quota", "copy", [key]).drop("__quota")
    near = nearest(minority, key, vector, k).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x["neighbour"])
        .alias("__near"))
    pick = (draw(f"{seed}/n", key, "copy") % F.size("__near")).cast("int")
    paired = attach(copies, near, key).withColumn("neighbour", F.get("__near", pick))
    paired = attach(paired, minority.select(F.col(key).alias("neighbour"), F.col(vector).alias("__end")), "neighbour")
    paired = paired.withColumn("__u", uniform(f"{seed}/u", key, "copy"))
    point = F.zip_with(vector, "__end", lambda a, b: a.cast("double") + F.col("__u") * (b.cast("double") - a.cast("double")))
    return paired.select(key, "copy", "neighbour", label, point.alias(vector))

