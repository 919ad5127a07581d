"""The entry points stand without the text queries and without the modules that only those need."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {gone!r} or name == {gone!r}:
            raise ModuleNotFoundError("No module named " + name, name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()), "slice_report" in entry.queries())
"""


def counted(gone):
    found = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, gone=gone)], capture_output=True, text=True, cwd=ROOT)
    return found


@pytest.mark.parametrize("gone", ["prepaudit.llm", "regex", "corpus_pipeline"])
def test_other_queries_survive_a_missing_module(gone):
    found = counted(gone)
    assert found.returncode == 0, found.stderr
    queries, sql, flagship = found.stdout.split()
    assert int(queries) > 120 and int(sql) > 100 and flagship == "True"


def test_a_module_of_the_library_itself_is_not_optional():
    assert counted("prepaudit.operators.clean").returncode != 0
