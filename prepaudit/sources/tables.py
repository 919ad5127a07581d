"""Tables in and out."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepaudit.operators.clean import placeholders_to_null


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
        placeholders: Sequence[str] = (), trim_left: bool = False) -> DataFrame:
    """Read a table with a header. State a schema where it is known: inferring one reads the data twice."""
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", trim_left)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    table = reader.csv(path)
    return placeholders_to_null(table, placeholders) if placeholders else table


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per row."""
    df.write.mode(mode).json(path)


def append(df: DataFrame, path: str) -> None:
    """Append result rows to a parquet log."""
    df.write.mode("append").parquet(path)


def json_map(spark: SparkSession, path: str, value_schema: str, key: str = "key", indent: int = 2) -> DataFrame:
    """Read ``{key: {...}}`` documents as one row per key.

    A document written with ``indent`` spaces per level is split where a line opens a key of the first level, so one large file is read by many
    tasks. One written on a single line is parsed as a whole.
    """
    pieces = spark.read.option("lineSep", "\n" + " " * indent + '"').text(path).select(F.rtrim(F.regexp_replace("value", r"\s+$", "")).alias("piece"))
    whole = F.startswith("piece", F.lit("{"))
    inner = F.when(F.endswith("piece", F.lit(",")), F.concat(F.lit('{"'), F.expr("left(piece, length(piece) - 1)"), F.lit("}"))).otherwise(
        F.concat(F.lit('{"'), "piece"))
    entries = pieces.filter(F.col("piece") != "{").select(F.when(whole, F.col("piece")).otherwise(inner).alias("value"))
    parsed = F.from_json("value", f"map<string, struct<{value_schema}>>")
    return entries.select(F.explode(parsed).alias(key, "__value")).select(key, "__value.*")


def write_json_map(df: DataFrame, path: str, key: str, indent: int = 2, mode: str = "errorifexists") -> None:
    """Write rows as ``{key: {...}}`` documents, one per batch of rows, indented by level. Values are plain numbers and strings."""
    def documents(batches):
        for batch in batches:
            found = batch.to_pylist()
            if found:
                body = json.dumps({str(r.pop(key)): r for r in found}, indent=indent, ensure_ascii=False)
                yield pa.RecordBatch.from_arrays([pa.array([body])], ["value"])
    df.mapInArrow(documents, "value string").write.mode(mode).option("lineSep", "\n").text(path)
