"""Vectorised text kernels that run inside Arrow tasks.

A batch of texts is one byte buffer. Words are runs of bytes other than
``0x20`` and ``0x09-0x0D``; no such byte occurs inside a multi-byte UTF-8
character, so the bytes are never decoded. Every word becomes a 64-bit hash of
its bytes with ``A-Z`` folded to ``a-z``. Chance collisions are of the order
n^2 / 2^65 for n distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

TEXT_BYTES = 2 * 1024 * 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salts(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def _letters() -> np.ndarray:
    table = salts(256, 11)
    table[65:91] = table[97:123]
    table[32] = 0
    table[9:14] = 0
    return table


LETTERS = _letters()
PLACES = salts(4096, 23)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Also cuts at every ASCII byte that is neither letter nor digit.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def places(n: int) -> np.ndarray:
    return PLACES if n <= len(PLACES) else salts(n, 23)


def slices(column: pa.Array, limit: int = TEXT_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``limit`` bytes (a longer text is a run of its own).

    Gives first row, end row, the bytes, and the byte offsets of the rows. Null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(n, max(first + 1, end))
        low, high = int(offsets[first]), int(offsets[end])
        yield first, end, data[low:high], offsets[first:end + 1] - low
        first = end
    pa.default_memory_pool().release_unused()  # workers live on; what a batch needed goes back


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and each row's first word number (one more entry than rows)."""
    size = len(data)
    solid = ~blank[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < size]
    begin[edges] = solid[edges]
    after = np.zeros(size + 1, bool)
    after[1:] = solid
    after[1:-1] &= ~solid[1:]
    cut = offsets[1:]
    cut = cut[cut > 0]
    after[cut] = solid[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(after)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, blank: np.ndarray = BLANK) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    inside = np.arange(len(data), dtype=np.int64)
    gaps = np.diff(np.append(starts, len(data)))
    inside[starts[0]:] -= np.repeat(starts, gaps)
    value = np.where(blank, np.uint64(0), LETTERS)[data[starts[0]:]]
    width = int(gaps.max())
    value = value * places(width)[inside[starts[0]:]]
    sums = np.add.reduceat(value, starts - starts[0])
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int,
                  blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the first ``size`` bytes of every longer word, and those words' numbers."""
    which = np.flatnonzero(ends - starts > size)
    table, place = np.where(blank, np.uint64(0), LETTERS), places(size)
    total = np.full(len(which), size, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(size):
        total += table[data[starts[which] + j]] * place[j]
    return mix(total), which


def texts_to_words(column: pa.Array, limit: int = TEXT_BYTES, blank: np.ndarray = BLANK):
    """``(first row, end row, word hashes, first word of each row)`` for runs of rows."""
    for first, end, data, offsets in slices(column, limit):
        starts, ends, bounds = word_spans(data, offsets, blank)
        yield first, end, word_hashes(data, starts, ends, blank), bounds


def row_numbers(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words inside a row; a shorter row gives its whole sequence.

    Returns the hashes and each row's first shingle number.
    """
    counts = np.diff(bounds)
    found = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out = np.zeros(len(found) + 1, np.int64)
    np.cumsum(found, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], found)
    factor = salts(width, 31)
    last = np.repeat(bounds[1:], found)
    total = np.zeros(len(at), np.uint64)
    padded = np.append(words, np.zeros(width, np.uint64))
    for j in range(width):
        total += np.where(at + j < last, padded[at + j] * factor[j], np.uint64(0))
    return mix(total), out


def row_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row in ascending (unsigned) order, and the new bounds."""
    return row_sets_of(values, row_numbers(bounds), len(bounds) - 1)


def ordered(values: np.ndarray, rows: np.ndarray, level: np.ndarray | None = None) -> np.ndarray:
    """Order by (row, level, value), rows not negative and levels below 256.

    One sort of packed keys does it, unless two different values agree in the bits that fit.
    """
    if not len(values):
        return np.zeros(0, np.int64)
    bits = max(1, int(rows.max()).bit_length())
    packed = rows.astype(np.uint64) << np.uint64(64 - bits)
    if level is not None:
        packed |= level.astype(np.uint64) << np.uint64(56 - bits)
        bits += 8
    packed |= values >> np.uint64(bits)
    order = np.argsort(packed)
    packed, sorted_values = packed[order], values[order]
    if ((packed[1:] == packed[:-1]) & (sorted_values[1:] != sorted_values[:-1])).any():
        return np.lexsort((values, rows) if level is None else (values, level, rows))
    return order


def row_sets_of(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for values with their row numbers."""
    order = ordered(values, rows)
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[keep], rows[keep]
    return values, np.searchsorted(rows, np.arange(n_rows + 1))


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary per row holding the row's slice of ``values``."""
    raw = np.ascontiguousarray(values)
    offsets = (np.asarray(bounds, np.int64) * raw.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One list of longs per row."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(bounds, np.int32)), pa.array(values.view(np.int64)))
