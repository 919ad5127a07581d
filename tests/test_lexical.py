"""The scan for code against Python's own parser."""

from __future__ import annotations

import ast
import glob
import os

import pytest
from pyspark.sql import functions as F

from prepaudit.functions import code
from prepaudit.functions.lexical import code_of

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def parsed(text):
    out = []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Import):
            out += [n.name for n in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [f"{node.module}.{n.name}" for n in node.names]
    return sorted(out)


SCRIPTS = [
    'import os\n"""\nimport nothing\n"""\nimport sys',
    "x = 1; import a.b as c, d\nif x: import e\nfor i in y: from f import g as h, k",
    "s = 'import x'  # import y\n# import z\nt = f\"from q import {r}\"\nimport real",
    "from m import (a,  # one, two\n    b as c,\n    d)\nfrom n import \\\n    e, f",
    "def f():\n    '''doc\n    import no\n    '''\n    import yes\n    return r'\\\\'",
    "a = b'\\'' + '\\\\'\nimport z1",
    "d = {'k': 'import n1', 'm': [\n  'import n2',\n]}\nimport z2",
    "",
]


def test_imports_of_scripts(spark):
    df = spark.createDataFrame(list(enumerate(SCRIPTS)), "i int, t string")
    for r in df.select("t", code.imports(F.col("t")).alias("found")).collect():
        assert sorted(r["found"]) == parsed(r["t"])


def test_imports_of_this_library(spark):
    """Every module of the library and its tests, as a corpus of real scripts."""
    texts = [open(p).read() for p in sorted(glob.glob(f"{ROOT}/prepaudit/**/*.py", recursive=True) + glob.glob(f"{ROOT}/tests/*.py"))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", code.imports(F.col("t")).alias("found")).collect():
        assert sorted(r["found"]) == parsed(r["t"])


@pytest.mark.parametrize("text", ['x = "open', "x = (1", "x = 1)", "'''never closed\nimport a", "x = [(])"])
def test_what_is_left_open_has_no_imports(spark, text):
    assert code_of(text) is None
    df = spark.createDataFrame([("import a\n" + text,), (None,)], "t string")
    assert [r[0] for r in df.select(code.imports(F.col("t"))).collect()] == [[], None]


def test_long_strings_do_not_recurse():
    assert code_of('"""' + "x \\n ' " * 200_000 + '"""\nimport a') == "''\nimport a"
