"""Counting the pieces of two texts where they lie, in one Arrow kernel per pair of columns.

Both sides of a pair are in one row, so nothing has to move to compare them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _grams(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct character n-grams as numbers, and their counts; exact up to n = 3, 64-bit mixed beyond."""
    codes = np.frombuffer((text or "").encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = max(0, len(codes) - n + 1)
    found = np.zeros(size, np.uint64)
    for i in range(n):
        found = found * np.uint64(1 << 21 if n <= 3 else 0x9E3779B97F4A7C15) + codes[i:i + size]
    return np.unique(found, return_counts=True)


def dice_of_grams(left: Column, right: Column, n: int) -> Column:
    """Multiset Dice coefficient of the character n-grams of two texts; 1 for two texts without any."""
    @F.pandas_udf("double")
    def dice(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.ones(len(a))
        for i, (x, y) in enumerate(zip(a, b)):
            (x, nx), (y, ny) = _grams(x, n), _grams(y, n)
            total = nx.sum() + ny.sum()
            if total:
                at = np.minimum(np.searchsorted(x, y), max(len(x) - 1, 0))
                both = x[at] == y if len(x) else np.zeros(len(y), bool)
                out[i] = 2.0 * np.minimum(nx[at[both]], ny[both]).sum() / total
        return pd.Series(out)
    return dice(left, right)


def _pieces(a: pa.Array, b: pa.Array):
    """Both sides' distinct (row, piece) numbers in order with their counts, the number of distinct pieces, and the pieces."""
    sizes = [pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False) for x in (a, b)]
    # One numbering of the whole batch: a piece is its place in the dictionary, so that texts are compared once.
    numbered = pa.concat_arrays([x.flatten() for x in (a, b)]).dictionary_encode("encode")
    code = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(1, len(numbered.dictionary))
    rows = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
    cut = int(sizes[0].sum())
    key = rows * width + code
    left, right = np.unique(key[:cut], return_counts=True), np.unique(key[cut:], return_counts=True)
    return left, right, sizes, width, numbered.dictionary


def dice_of_pieces(left: Column, right: Column) -> Column:
    """The same for two arrays of strings."""
    @F.arrow_udf("double")
    def dice(a: pa.Array, b: pa.Array) -> pa.Array:
        (x, nx), (y, ny), sizes, width, _ = _pieces(a, b)
        both, at, to = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        shared = np.bincount(both // width, np.minimum(nx[at], ny[to]), len(a))
        total = sizes[0] + sizes[1]
        return pa.array(np.where(total > 0, 2.0 * shared / np.maximum(total, 1), 1.0))
    return dice(left, right)


def changes(left: Column, right: Column, marked: Callable[[str], bool]) -> Column:
    """``struct<added, removed, marked>``: pieces only on one side as multisets, and how many of them are marked."""
    @F.arrow_udf("added bigint, removed bigint, marked bigint")
    def differ(a: pa.Array, b: pa.Array) -> pa.Array:
        (x, nx), (y, ny), _, width, pieces = _pieces(a, b)
        _, at, to = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        shared = np.minimum(nx[at], ny[to])
        less, more = nx.copy(), ny.copy()
        less[at] -= shared
        more[to] -= shared
        flags = np.array([p is not None and marked(p) for p in pieces.to_pylist()] or [False])
        sums = [np.bincount(key // width, weight, len(a)).astype(np.int64) for key, weight in (
            (y, more), (x, less), (np.append(x, y), np.append(less * flags[x % width], more * flags[y % width])))]
        return pa.StructArray.from_arrays([pa.array(c) for c in sums], ["added", "removed", "marked"])
    return differ(left, right)
