"""Operators for preparing training text at scale, each with its query."""

from __future__ import annotations

import importlib

MODULES = [
    "bpe", "decontaminate", "exact", "jaccard", "licenses", "lines", "lm", "passages", "parsing", "periods",
    "search", "secrets", "toxicity",
]


def _load():
    for name in MODULES:
        importlib.import_module(f"prepaudit.llm.{name}")
    from prepaudit.llm.shared import QUERIES, SQL
    return QUERIES, SQL


def llm_queries() -> dict:
    return dict(_load()[0])


def llm_sql() -> dict:
    return dict(_load()[1])
