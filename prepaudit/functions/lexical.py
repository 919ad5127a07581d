"""Which parts of a script are code: a scan that knows strings, comments and continued lines, and no grammar."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a scan meets next: a string of any kind (its end may be missing), a comment, a continued line, or a bracket.
TOKEN = re.compile(r'''
    (?P<string>[rRbBuUfF]{0,2}(?:
        """(?:[^"\\]|\\.|"(?!""))*(?P<a>""")? | \'\'\'(?:[^'\\]|\\.|'(?!\'\'))*(?P<b>\'\'\')?
      | "(?:[^"\\\n]|\\.)*(?P<c>")? | '(?:[^'\\\n]|\\.)*(?P<d>')?))
  | (?P<comment>\#[^\n]*)
  | (?P<joined>\\\r?\n)
  | (?P<open>[(\[{]) | (?P<close>[)\]}])''', re.VERBOSE | re.DOTALL)
PARTNER = {")": "(", "]": "[", "}": "{"}


def code_of(text: str) -> str | None:
    """The text with strings emptied, comments dropped, continued lines joined and bracketed line ends blanked; None if a string or a bracket is left open."""
    out, at, open_ = [], 0, []
    for hit in TOKEN.finditer(text):
        between = text[at:hit.start()]
        out.append(between.replace("\n", " ") if open_ else between)
        at, kind, found = hit.end(), hit.lastgroup, hit.group()
        if hit["string"] is not None:
            if not (hit["a"] or hit["b"] or hit["c"] or hit["d"]):
                return None
            if hit.start() and (text[hit.start() - 1].isalnum() or text[hit.start() - 1] == "_") and found[0] in "rRbBuUfF":
                out.append(found[:len(found) - len(found.lstrip("rRbBuUfF"))])  # the end of a name, not a prefix
            out.append("''")
        elif kind == "joined":
            out.append(" ")
        elif kind == "open":
            open_.append(found)
            out.append(found)
        elif kind == "close":
            if not open_ or open_.pop() != PARTNER[found]:
                return None
            out.append(found)
    if open_:
        return None
    return "".join([*out, text[at:]])


def code_only(column: Column) -> Column:
    """Only the code of a script, one statement's start per line at least; null for what cannot be one, or for null."""
    @F.pandas_udf("string")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(code_of, na_action="ignore")
    return scan(column.cast("string"))
