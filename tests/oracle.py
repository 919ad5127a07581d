"""Run registered queries on Spark and their SQL on DuckDB and compare whole results.

    python tests/oracle.py [folder] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _sortable(row):
    return tuple((v is None, "" if v is None else repr(v) if not isinstance(v, str) else v) for v in row)


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0 or 0.0
    return v


def compare(df, connection, sql: str) -> str | None:
    """None when schema and values agree, else what differs."""
    result = connection.execute(sql)
    expected = {c[0]: str(c[1]) for c in result.description}
    columns = sorted(df.columns)
    if columns != sorted(expected):
        return f"columns {columns} != {sorted(expected)}"
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != expected[name]:
            return f"type of {name}: {kind} != {expected[name]}"
    order = [list(expected).index(c) for c in columns]
    theirs = sorted((tuple(_plain(r[i]) for i in order) for r in result.fetchall()), key=_sortable)
    ours = sorted((tuple(_plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=_sortable)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{sum(x != y for x, y in zip(ours, theirs))} of {len(ours)} rows differ, first {str(a)[:300]} != {str(b)[:300]}"
    return None if ours else "no rows"


def main(arguments):
    from tests.conftest import new_session
    from __spark_entry__ import oracle_sql, queries

    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    chosen = arguments[1:] or list(queries())
    spark, connection = new_session(), connect(folder)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            df = queries()[name](spark, folder)
            sql = oracle_sql().get(name)
            verdict = compare(df, connection, sql) if sql else f"rows only: {df.count()}"
        except Exception as error:  # the report goes on with the next query
            verdict = f"{type(error).__name__}: {str(error)[:900]}"
        fine = verdict is None or verdict.startswith("rows only")
        bad += not fine
        print(f"{'ok  ' if fine else 'FAIL'} {name} {time.time() - start:.2f}s {verdict or ''}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")


if __name__ == "__main__":
    main(sys.argv[1:])
