"""What the operators of this subpackage share: reading, storing, connected components, registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepaudit.operators.distributed import SHUFFLES_GO, broadcast_if_small, ensure_checkpoint_dir, settle, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return keep


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for the ends ``a``, ``b`` of undirected links; component is the smallest id reached.

    Alternating large-star and small-star rounds: every round links each vertex
    to the least vertex around it, so chains shrink geometrically and a vertex of high
    degree only ever costs one partial aggregation. Rounds go on until nothing changes.
    """
    links = store(
        edges.filter((F.col("a") != F.col("b")) & F.col("a").isNotNull() & F.col("b").isNotNull())
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = (both.filter(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("v"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), "m")
        small = (large.join(lowest, F.col("a") == F.col("v"))
                 .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                         F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct())
        links = store(small)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    tops = links.select(F.col("b").alias("id")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        tops.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


__all__ = ["QUERIES", "SHUFFLES_GO", "SQL", "broadcast_if_small", "components", "ensure_checkpoint_dir", "read", "register",
           "settle", "store", "text_of"]
