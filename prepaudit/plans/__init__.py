"""Registered queries over the given tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from prepaudit.plans import audit, corpus, files, runlog, sampling, tabular, training  # noqa: F401
from prepaudit.plans.registry import QUERIES, SQL


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict:
    return dict(SQL)
