"""Plain-Python versions of what the operators promise, for small tables."""

from __future__ import annotations

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(low(text))


def shingles(text, width):
    w = words(text)
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))


def similar(a, b, num, den):
    both = len(a & b)
    return both * den >= num * (len(a) + len(b) - both)


def components(rows, width, num, den):
    """``{id: least id reached}`` of rows without null ids."""
    sets = [(key, shingles(text, width)) for key, text in rows if key is not None]
    top = {key: key for key, _ in sets}

    def find(v):
        while top[v] != v:
            v = top[v]
        return v
    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and similar(a, b, num, den):
            x, y = sorted((find(i), find(j)))
            top[y] = x
    return {key: find(key) for key in top}
