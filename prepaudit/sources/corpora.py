"""Folders of texts: one folder per case, one file per role."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(case, file, text)`` of every file below ``path/<case>/``; a missing file simply has no row."""
    read = spark.read.option("pathGlobFilter", pattern).text(f"{path.rstrip('/')}/*", wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return read.select(F.element_at(parts, -2).alias("case"), F.element_at(parts, -1).alias("file"),
                       F.col("value").alias("text"))


def with_roles(files: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Name the role of each file; files without a role are left out."""
    pairs = [x for file, role in roles.items() for x in (F.lit(file), F.lit(role))]
    return files.withColumn("role", F.try_element_at(F.create_map(*pairs), F.col("file"))).filter(
        F.col("role").isNotNull())
