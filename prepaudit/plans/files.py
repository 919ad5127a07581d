"""Queries over sources and sinks: a given table is written in a form, below the checkpoint folder, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from prepaudit.operators import cases
from prepaudit.operators.distributed import ensure_checkpoint_dir
from prepaudit.plans.inputs import table
from prepaudit.plans.registry import query
from prepaudit.sources import corpora, runstore, tables


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see; the cluster's to clean, like a checkpoint."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{uuid.uuid4().hex}"


@query("csv_round_trip", """
    SELECT o_orderkey, o_totalprice, nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders""")
def csv_round_trip(spark, folder):
    """Orders as CSV with a header; an unspecified priority is a placeholder on the way back."""
    path = scratch(spark)
    tables.write_csv(table(spark, folder, "orders", "o_orderkey", "o_totalprice", "o_orderpriority"), path)
    return tables.csv(spark, path, "o_orderkey bigint, o_totalprice double, o_orderpriority string", placeholders=["4-NOT SPECIFIED"])


@query("json_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_round_trip(spark, folder):
    """Customers as one JSON object per row."""
    path = scratch(spark)
    tables.write_json(table(spark, folder, "customer", "c_custkey", "c_name", "c_acctbal"), path)
    return spark.read.schema("c_custkey bigint, c_name string, c_acctbal double").json(path)


@query("json_map_round_trip", "SELECT CAST(s_suppkey AS VARCHAR) AS supplier, s_name, s_acctbal FROM supplier")
def json_map_round_trip(spark, folder):
    """Suppliers as indented maps from key to object, read back entry by entry."""
    path = scratch(spark)
    tables.write_json_map(table(spark, folder, "supplier", "s_suppkey", "s_name", "s_acctbal"), path, "s_suppkey")
    return tables.json_map(spark, path, "s_name: string, s_acctbal: double", "supplier")


@query("log_appends", """
    SELECT n_nationkey, n_name, attempt::INT AS attempt FROM nation, (SELECT unnest([1, 2]) AS attempt)""")
def log_appends(spark, folder):
    """Nations appended to a log twice."""
    path = scratch(spark)
    for attempt in (1, 2):
        tables.append(table(spark, folder, "nation", "n_nationkey", "n_name").withColumn("attempt", F.lit(attempt)), path)
    return spark.read.parquet(path)


@query("run_records", """
    SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS key, count(*) AS n, round(sum(value), 6) AS total
    FROM events GROUP BY ALL""")
def run_records(spark, folder):
    """Events as the metrics of their users' runs, appended to the run tables and summed from there."""
    path = scratch(spark)
    events = table(spark, folder, "events", "user_id", "event_type", "value")
    told = events.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("key"), F.lit(0).alias("ts"), "value", F.lit(0).alias("step"))
    runstore.append_records(told, path, "run_metrics")
    back = runstore.read_records(spark, path, "run_metrics")
    return back.groupBy("run_id", "key").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("case_folders", """
    SELECT concat('case=', s_nationkey) AS "case", count(*) AS lines FROM supplier WHERE s_nationkey % 5 <> 0 GROUP BY ALL""")
def case_folders(spark, folder):
    """Suppliers' names as a folder per nation with a text in it; every file is one value, and some folders are left out by name."""
    path = scratch(spark)
    names = table(spark, folder, "supplier", "s_nationkey", "s_name").select(F.col("s_nationkey").alias("case"), F.col("s_name").alias("value"))
    names.repartition("case").write.partitionBy("case").text(path)
    tagged = corpora.texts(spark, path, "*.txt").withColumn("tag", F.concat("case", F.lit(".")))
    kept = cases.excluding(tagged, *[f"{n}." for n in (0, 5)], column="tag")
    lines = F.size(F.filter(F.split("text", "\n"), lambda line: line != ""))
    return kept.groupBy("case").agg(F.sum(lines).cast("bigint").alias("lines"))
