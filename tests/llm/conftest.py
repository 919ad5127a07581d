from __future__ import annotations

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])


@pytest.fixture(scope="session")
def texts(spark):
    """A table of documents from ``{id: text}`` or ``[(id, text)]``."""
    def make(rows):
        rows = list(rows.items()) if isinstance(rows, dict) else list(rows)
        return spark.createDataFrame(rows, SCHEMA)
    return make


#: Columns whose names clash with those the operators use inside.
CLASHING = ("id", "n", "at", "text_sha256", "word", "seed", "row", "score", "hits", "ids", "a", "b", "d1", "g", "head", "line",
            "prefix", "source", "rep", "key", "other", "run", "digest", "token", "start", "kept")


@pytest.fixture(scope="session")
def clashing(spark):
    from pyspark.sql import functions as F

    def add(df):
        return df.withColumns({c: F.lit(f"x{c}") for c in CLASHING})
    return add
