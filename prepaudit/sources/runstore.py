"""Run records: appended as tables, or read back from a store of small files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepaudit.functions.text import strip
from prepaudit.sources.tables import append

TABLES = {
    "runs": "run_id string, experiment_id string, run_name string, start_time bigint, end_time bigint, status int",
    "run_metrics": "run_id string, key string, ts bigint, value double, step bigint",
    "run_params": "run_id string, key string, value string",
    "run_artifacts": "run_id string, name string, text string",
}
META_FIELDS = ["run_id", "experiment_id", "run_name", "start_time", "end_time", "status"]


def append_records(df: DataFrame, folder: str, table: str) -> None:
    """Append rows to one of the run tables, in its column order and types."""
    fields = [f.strip().split(" ") for f in TABLES[table].split(",")]
    append(df.select(*[F.col(n).cast(t).alias(n) for n, t in fields]), f"{folder.rstrip('/')}/{table}")


def read_records(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{folder.rstrip('/')}/{table}")


def _files(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    parts = F.split(F.col("_metadata.file_path"), "/")
    return spark.read.text(path, wholetext=whole).select("value", parts.alias("parts"))


def scan_runs(spark: SparkSession, store: str) -> DataFrame:
    """Runs from ``<store>/<experiment>/<run>/meta.yaml`` files of ``key: value`` lines."""
    rows = _files(spark, f"{store.rstrip('/')}/*/*/meta.yaml")
    pair = F.split("value", ": ", 2)
    cells = rows.select(F.element_at("parts", -2).alias("folder"), strip(F.get(pair, F.lit(0))).alias("key"),
                        F.regexp_replace(strip(F.get(pair, F.lit(1))), "^'|'$", "").alias("v"))
    wide = cells.groupBy("folder").pivot("key", META_FIELDS).agg(F.first("v"))
    types = {"start_time": "bigint", "end_time": "bigint", "status": "int"}
    return wide.select(*[F.col(c).try_cast(types.get(c, "string")).alias(c) for c in META_FIELDS])


def scan_metrics(spark: SparkSession, store: str) -> DataFrame:
    """``ts value step`` lines of ``<store>/<experiment>/<run>/metrics/<key>``."""
    rows = _files(spark, f"{store.rstrip('/')}/*/*/metrics/*")
    cell = F.split("value", " ")
    return rows.select(F.element_at("parts", -3).alias("run_id"), F.element_at("parts", -1).alias("key"),
                       F.get(cell, F.lit(0)).try_cast("bigint").alias("ts"),
                       F.get(cell, F.lit(1)).try_cast("double").alias("value"),
                       F.get(cell, F.lit(2)).try_cast("bigint").alias("step"))


def scan_params(spark: SparkSession, store: str, kind: str = "params") -> DataFrame:
    """One-value files of ``<store>/<experiment>/<run>/<kind>/<key>`` (parameters or tags)."""
    rows = _files(spark, f"{store.rstrip('/')}/*/*/{kind}/*", whole=True)
    return rows.select(F.element_at("parts", -3).alias("run_id"), F.element_at("parts", -1).alias("key"),
                       strip(F.col("value")).alias("value"))
