"""Exact nearest neighbours without a cross join.

Equal vectors are first folded into one representative, so a large group of
copies costs one row. Representatives are sorted by their distance to the mean vector
and cut into blocks of bounded size. A first pass inside each block gives every row an upper bound on
the distance of its k-th neighbour. By the triangle inequality no block whose
distances to the mean lie outside that bound can hold a nearer row, so only
the remaining block pairs are compared, each in a task of its own that emits
at most k rows per row. With well-spread low-dimensional data few pairs remain;
on data without structure the result is still exact but many do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prepaudit.functions.hashing import digest
from prepaudit.operators.distributed import running_total, settle

DIGITS = 6


def _closest(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, owner: np.ndarray, k: int):
    """Per query the k smallest (rounded distance, id) over the ids that each point owns.

    Expanded squares pick the candidates. Their error grows with the norms, so both sides are moved to the points' mean
    first, and the error that is left is allowed for.
    """
    centre = points.mean(axis=0)
    a, b = queries - centre, points - centre
    norms_a, norms_b = (a**2).sum(1), (b**2).sum(1)
    error = 4.0 * np.finfo(float).eps * (a.shape[1] + 4) * (norms_a + norms_b.max())
    rough = (norms_a[:, None] + norms_b[None, :] - 2.0 * a @ b.T)[:, owner]
    keep = min(k, rough.shape[1])
    farthest = np.maximum(np.partition(rough, keep - 1, axis=1)[:, keep - 1] + error, 0.0)
    bound = (np.sqrt(farthest) + 10.0**-DIGITS) ** 2 + error
    for row, query in enumerate(queries):
        near = np.flatnonzero(rough[row] <= bound[row])
        exact = np.round(np.sqrt(((points[owner[near]] - query) ** 2).sum(1)), DIGITS)
        order = np.lexsort((ids[near], exact))[:keep]
        yield exact[order].tolist(), ids[near][order].tolist()


def _members(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    counts = frame["members"].map(len).to_numpy()
    return np.concatenate(frame["members"].to_list()), np.repeat(np.arange(len(frame)), counts)


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["__v"].to_list()).astype("float64")


def _found(frame: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    ids, owner = _members(candidates)
    closest = list(_closest(_matrix(frame), _matrix(candidates), ids, owner, k))
    return pd.DataFrame({"rep": frame["rep"].to_numpy(),
                         "distances": [c[0] for c in closest], "ids": [c[1] for c in closest]})


def _folded(df: DataFrame, key: str, vector: str, keep: int) -> DataFrame:
    """One row per distinct vector with the ``keep`` smallest keys that share it."""
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("__v"))
    rows = rows.withColumn("salt", F.substring(digest("salt", "id"), 1, 2))
    first = Window.partitionBy("__v", "salt").orderBy("id")
    second = Window.partitionBy("__v").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= keep)
    few = few.withColumn("r", F.row_number().over(second)).filter(F.col("r") <= keep)
    folded = few.groupBy("__v").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return folded.withColumn("rep", F.get("members", F.lit(0)))


def _from_other_blocks(placed: DataFrame, own: DataFrame, key_type: str, want: int) -> DataFrame:
    """Neighbours found in the blocks that may hold nearer rows than a row's own block."""
    found_type = f"rep {key_type}, distances array<double>, ids array<{key_type}>"
    slack = 2 * 10.0**-DIGITS
    reach = F.when(F.size("distances") >= want, F.element_at("distances", -1) + slack)
    bounded = own.select("rep", F.coalesce(reach, F.lit(float("inf"))).alias("reach"))
    rows = placed.select("rep", "d", "block").join(bounded, "rep")

    blocks = placed.groupBy("block").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    none = F.lit(None).cast(key_type)

    def blocks_passed(query, edge, query_first):
        asked = rows.select(F.col("rep"), query.alias("at"), F.lit(0 if query_first else 1).alias("turn"),
                            F.lit(0).alias("one"), F.lit(None).cast("bigint").alias("b"))
        edges = blocks.select(none.alias("rep"), F.col(edge).alias("at"), F.lit(1 if query_first else 0).alias("turn"),
                              F.lit(1).alias("one"), F.col("block").alias("b"))
        counted = running_total(asked.unionByName(edges), [], ["at", "turn", "rep", "b"], passed="one")
        return counted.filter(F.col("rep").isNotNull()).select("rep", "passed")

    first = blocks_passed(F.col("d") - F.col("reach"), "hi", True).withColumnRenamed("passed", "first")
    last = blocks_passed(F.col("d") + F.col("reach"), "lo", False).withColumnRenamed("passed", "last")
    targets = F.sequence(F.col("first"), F.col("last") - 1)
    asked = first.join(last, "rep").filter(F.col("last") > F.col("first")).select("rep", F.explode(targets).alias("target"))
    asked = asked.join(placed.select("rep", "block"), "rep").filter(F.col("target") != F.col("block"))
    asked = settle(asked)
    pairs = asked.select(F.col("target").alias("of"), F.col("block").alias("by")).distinct()
    asked = asked.join(placed.select(F.col("rep").alias("__rep"), "__v"), F.col("rep") == F.col("__rep")).drop("__rep")
    points = placed.select(F.col("block").alias("of"), F.col("rep").alias("point"), F.col("__v").alias("__p"), "members")
    candidates = points.join(pairs, "of").select("of", "by", "point", F.col("__p").alias("__v"), F.col("members"))
    return asked.groupBy("target", "block").cogroup(candidates.groupBy("of", "by")).applyInPandas(
        lambda queries, points: _found(queries, points, want), found_type)


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, block_rows: int = 1024) -> DataFrame:
    """``(key, rank, neighbour, distance)``: each row's k nearest other rows, by rounded distance, then key."""
    want = k + 1
    key_type = df.schema[key].dataType.simpleString()
    folded = settle(_folded(df, key, vector, want))

    centre = folded.select(vector_to_array(Summarizer.mean(array_to_vector("__v")))).first()[0] or []
    gaps = F.zip_with("__v", F.array(*[F.lit(x) for x in centre]), lambda a, b: (a - b) * (a - b))
    measured = folded.withColumn("d", F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)))
    placed = running_total(measured, [], ["d", "rep"], place=F.lit(1).cast("bigint"))
    placed = settle(placed.withColumn("block", F.floor((F.col("place") - 1) / F.lit(block_rows))).drop("place"))

    found_type = f"rep {key_type}, distances array<double>, ids array<{key_type}>"
    own = settle(placed.select("block", "rep", "__v", "members").groupBy("block").applyInPandas(
        lambda frame: _found(frame, frame, want), found_type))
    blocks = (placed.agg(F.max("block")).first()[0] or 0) + 1
    if blocks > 1:
        own = own.unionByName(_from_other_blocks(placed, own, key_type, want))
    merged = own.select("rep", F.inline(F.arrays_zip("distances", "ids")))
    best = F.row_number().over(Window.partitionBy("rep").orderBy("distances", "ids"))
    lists = (
        merged.withColumn("r", best).filter(F.col("r") <= want)
        .groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("distances", "ids"))).alias("near"))
    )
    by_vector = placed.select("rep", F.col("__v").alias("__same")).join(lists, "rep").drop("rep")
    wide = df.select(F.col(key), F.transform(vector, lambda x: x.cast("double")).alias("__v"))
    joined = wide.join(by_vector, F.col("__v") == F.col("__same"))
    others = F.slice(F.filter("near", lambda x: x["ids"] != F.col(key)), 1, k)
    return joined.select(key, F.posexplode(others).alias("pos", "hit")).select(
        key, (F.col("pos") + 1).alias("rank"), F.col("hit.ids").alias("neighbour"),
        F.col("hit.distances").alias("distance"))

