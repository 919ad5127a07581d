"""Turning columns of one row into rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def stacked(*rows: Mapping[str, object]) -> Column:
    """An array of structs for ``inline``: one per mapping, plain values become literals."""
    def struct(row):
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in row.items()])
    return F.array(*[struct(r) for r in rows])
