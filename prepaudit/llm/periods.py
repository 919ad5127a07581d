"""Periodic runs of words: maximal stretches that repeat a word, a line or a paragraph several times over.

Every run that holds its period ``q`` four times begins within ``q`` words before some place ``k * q``, and the words there agree with those
``q`` later for at least ``2 * q`` words. So all pairs ``(k * q, (k + 1) * q)`` of the harmonic grid, about n log n of them, are asked
for their longest common extensions to either side. Those come from a difference cover: suffixes are sorted at cover places only, any
two places reach a pair of them within fewer than ``COVER_PERIOD`` words, and beyond that a sparse table
of minima over neighbours' common blocks answers at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepaudit.llm.kernel import mix, salts, slices, word_spans
from prepaudit.llm.parsing import Rolling
from prepaudit.llm.shared import read, register

#: Each difference modulo 13 is a difference of two of these.
COVER_PERIOD, COVER = 13, (0, 1, 3, 9)
LEAST_LENGTH = 6
LEAST_EXPONENT = 4
TEXT_BYTES = 512 * 1024
GRID_PAIRS = 1 << 20
PIECE_WORDS = 1 << 16


def _steps() -> np.ndarray:
    """For two places modulo the period, how far both must go to reach the cover."""
    v = COVER_PERIOD
    inside = np.isin(np.arange(v), COVER)
    return np.array([[next(d for d in range(v) if inside[(i + d) % v] and inside[(j + d) % v]) for j in range(v)] for i in range(v)])


_STEPS = _steps()


class Extensions:
    """Longest common extensions of places in a sequence whose texts each end in a symbol of their own."""

    def __init__(self, symbols: np.ndarray):
        v, n = COVER_PERIOD, len(symbols)
        self.symbols = np.concatenate([symbols, mix(np.arange(2 * v, dtype=np.uint64) + np.uint64(1 << 62))])
        blocks = np.zeros(n + 1, np.uint64)
        for j, factor in enumerate(salts(v, 41)):
            blocks += mix(self.symbols[j:j + n + 1]) * factor
        places = np.flatnonzero(np.isin(np.arange(n) % v, COVER))
        self.number = np.full(n + 1, -1, np.int64)
        self.number[places] = np.arange(len(places))
        # Names of 1, 2, 4, ... blocks; two suffixes compare by the names of their blocks, in any fixed order of names.
        names = [np.unique(blocks[places], return_inverse=True)[1] + 1]
        while int(names[-1].max(initial=0)) < len(places):
            after = places + (v << (len(names) - 1))
            follow = np.where(after < n, names[-1][self.number[np.minimum(after, n - 1)]], 0)
            pair = names[-1].astype(np.int64) * (len(places) + 1) + follow
            names.append(np.unique(pair, return_inverse=True)[1] + 1)
        self.rank = names[-1] - 1
        order = np.argsort(self.rank)
        # Common blocks of neighbours in that order, from the longest names down.
        a, b = places[order[:-1]], places[order[1:]]
        common = np.zeros(len(a), np.int64)
        for k in range(len(names) - 1, -1, -1):
            x, y = a + common * v, b + common * v
            here = np.flatnonzero((x < n) & (y < n))
            same = here[names[k][self.number[x[here]]] == names[k][self.number[y[here]]]]
            common[same] += 1 << k
        self.minima = [common]
        while 2 << (len(self.minima) - 1) <= len(common):
            half, last = 1 << (len(self.minima) - 1), self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def _walk(self, i: np.ndarray, j: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """How many of the next ``steps`` words agree before the first that does not."""
        agreed, open_ = np.zeros(len(i), np.int64), np.flatnonzero(steps > 0)
        for t in range(int(steps.max(initial=0))):
            open_ = open_[(steps[open_] > t)]
            open_ = open_[self.symbols[i[open_] + t] == self.symbols[j[open_] + t]]
            if not len(open_):
                break
            agreed[open_] = t + 1
        return agreed

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``i`` and at ``j``, which differ."""
        v = COVER_PERIOD
        steps = _STEPS[i % v, j % v]
        length = self._walk(i, j, steps)
        go = np.flatnonzero(length == steps)
        if not len(go):
            return length
        x, y = i[go] + steps[go], j[go] + steps[go]
        a, b = self.rank[self.number[x]], self.rank[self.number[y]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.floor(np.log2(high - low)).astype(np.int64)
        common = np.empty(len(go), np.int64)
        for k in np.unique(level):
            w = np.flatnonzero(level == k)
            common[w] = np.minimum(self.minima[k][low[w]], self.minima[k][high[w] - (1 << int(k))])
        x, y = x + common * v, y + common * v
        length[go] += common * v + self._walk(x, y, np.full(len(go), v))
        return length


def grid(sizes: np.ndarray, bounds: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods ``(at, q)`` of the harmonic grid of every text, some at a time."""
    most = sizes // exponent
    first = 0
    while first < len(sizes):  # texts whose periods are listed together
        end = max(first + 1, int(np.searchsorted(np.cumsum(most[first:]), GRID_PAIRS, "right")) + first)
        text = np.repeat(np.arange(first, end), most[first:end])
        period = np.arange(len(text)) - np.repeat(np.cumsum(most[first:end]) - most[first:end], most[first:end]) + 1
        times = sizes[text] // period - (exponent - 2)
        upto = np.cumsum(times)
        a = 0
        while a < len(text):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + GRID_PAIRS, "right")))
            some = times[a:b]
            q = np.repeat(period[a:b], some)
            k = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
            yield np.repeat(bounds[text[a:b]], some) + k * q, q
            a = b
        first = end


def runs(symbols: np.ndarray, bounds: np.ndarray, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows ``(text, start, length, period)`` of all runs of several texts, by text, start and period.

    ``exponent`` is at least 3, so that a run found with a multiple of its period has the same ends and is told by them.
    """
    none = np.zeros((0, 4), np.int64)
    sizes = np.diff(bounds)
    ats, periods = [], []
    for at, q in grid(sizes, bounds, exponent):
        for back in range(min(2, exponent - 2)):  # words that every run's pair agrees in; most pairs end here
            keep = symbols[at + back * q] == symbols[at + (back + 1) * q]
            at, q = at[keep], q[keep]
        keep = (symbols[at + q - 1] == symbols[at + 2 * q - 1]) & (symbols[at + q // 2] == symbols[at + q + q // 2])
        ats.append(at[keep])
        periods.append(q[keep])
    if not ats or not sum(map(len, ats)):
        return none
    at, q = np.concatenate(ats), np.concatenate(periods)
    # Only texts with pairs left are sorted, each closed by a symbol of its own.
    text = np.searchsorted(bounds, at, "right") - 1
    used = np.unique(text)
    new_sizes = sizes[used] + 1
    new_bounds = np.cumsum(new_sizes) - new_sizes
    inside = np.arange(int(new_sizes.sum())) - np.repeat(new_bounds, new_sizes)
    closing = inside == np.repeat(sizes[used], new_sizes)
    source = np.minimum(np.repeat(bounds[used], new_sizes) + inside, len(symbols) - 1)
    packed = np.where(closing, mix(np.repeat(np.arange(len(used), dtype=np.uint64), new_sizes) + np.uint64(1 << 61)), symbols[source])
    which = np.searchsorted(used, text)
    local = at - bounds[text]
    i = new_bounds[which] + local
    forward = Extensions(packed)(i, i + q)
    keep = forward >= (exponent - 2) * q
    i, q, which, local, forward = i[keep], q[keep], which[keep], local[keep], forward[keep]
    if not len(i):
        return none
    # Backwards, a text is closed by the symbol of the text before it, and the first one by another.
    turned = np.append(packed[::-1], mix(np.array([1 << 60], np.uint64)))
    backward = Extensions(turned)(len(packed) - i, len(packed) - i - q)
    start, length = local - backward, q + forward + backward
    keep = (backward < q) & (length >= np.maximum(least, exponent * q))
    found = np.stack([used[which], start, length, q], 1)[keep]
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    same = np.zeros(len(found), bool)
    same[1:] = (found[1:, :3] == found[:-1, :3]).all(axis=1)
    found = found[~same]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray | None) -> Iterator[bytes]:
    """Words in an order, or all of them, joined by one space, some at a time."""
    total = len(starts) if order is None else len(order)
    raw = b"" if order is None else data.tobytes()
    for a in range(0, total, PIECE_WORDS):
        b = min(total, a + PIECE_WORDS)
        if order is None:
            piece = data[starts[a]:ends[b - 1]].tobytes().split()
        else:
            some = order[a:b]
            piece = [raw[s:e] for s, e in zip(starts[some].tolist(), ends[some].tolist())]
        yield (b" " if a else b"") + b" ".join(piece)


Rewrite = Callable[[int, int], "tuple[int, int] | None"]


def _described(rewrite: Rewrite | None, least: int, exponent: int, with_text: bool):
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
                        *([("collapsed", pa.binary())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for first, end, data, offsets in slices(batch.column(1), TEXT_BYTES):
                starts, ends, bounds = word_spans(data, offsets)
                symbols = Rolling(data).stretch(starts, ends)
                source = np.arange(len(starts))
                changed = set()
                for r in range(end - first) if rewrite else ():
                    a, b = int(bounds[r]), int(bounds[r + 1])
                    key = keys[first + r].as_py()
                    if b > a and key is not None and (tail := rewrite(key, b - a)) is not None:
                        at, period = tail
                        source[a + at:b] = a + at + np.arange(b - a - at) % period
                        changed.add(r)
                found = runs(symbols[source], bounds, least, exponent)
                edges = np.searchsorted(found[:, 0], np.arange(end - first + 1))
                out = []
                for r in range(end - first):
                    a, b = int(bounds[r]), int(bounds[r + 1])
                    mine = found[edges[r]:edges[r + 1], 1:]
                    order = None
                    if len(mine) or r in changed:
                        dropped = np.zeros(b - a + 1, np.int64)
                        np.add.at(dropped, mine[:, 0] + mine[:, 2], 1)
                        np.add.at(dropped, mine[:, 0] + mine[:, 1], -1)
                        order = source[a:b][np.cumsum(dropped)[:-1] == 0] - a
                    low = int(starts[a]) if b > a else 0
                    high = int(ends[b - 1]) if b > a else 0
                    text = hashlib.sha256()
                    pieces = []
                    for piece in _joined(data[low:high], starts[a:b] - low, ends[a:b] - low, order):
                        text.update(piece)
                        if with_text:
                            pieces.append(piece)
                    listed = mine.tolist()
                    lines = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in listed).encode()).hexdigest()
                    out.append((b - a, [{"start": s, "length": n, "period": q} for s, n, q in listed], lines, text.hexdigest(),
                                *([b"".join(pieces)] if with_text else [])))
                yield pa.RecordBatch.from_arrays([keys.slice(first, end - first), *(pa.array(c, f.type) for c, f in zip(zip(*out), schema))],
                                                 ["id", *schema.names])
    return run


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT,
                  rewrite: Rewrite | None = None, with_text: bool = False) -> DataFrame:
    """``(<key>, n_words, runs, runs_sha256, collapsed_sha256[, collapsed])`` for every row.

    Words are runs of anything but ASCII white space, compared byte by byte (as 64-bit hashes) with their case. ``runs`` lists ``(start, length,
    period)``, in words, of every maximal stretch with smallest period ``period`` and at least ``max(least, exponent *
    period)`` words, by start and period; ``exponent`` is 3 or more. The collapsed text keeps of each run its first period, and
    joins the words that stay by one space. ``rewrite(key, n)`` may name a place and a period with which a text of ``n`` words goes
    on from there, as tests of the detection do; it is not asked for rows without a key or word.

    Each text is searched by itself, in memory of some 60 bytes per byte of the longest one. Null and empty texts have no words and
    no runs; rows that repeat an id are searched each by itself; other columns are not read; an empty table gives an empty table.
    """
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    found = given.mapInArrow(_described(rewrite, least, exponent, with_text),
                             f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
                             "runs_sha256 string, collapsed_sha256 string" + ", collapsed binary" * with_text)
    return found.withColumnRenamed("id", key)


def repeated_tail(key: int, n: int) -> tuple[int, int] | None:
    """Of every tenth id, by its checksum, the text goes on from some word with the words that follow there, over and over."""
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    at = g % n
    return at, 1 + (n - at) // (3 + g % 8)


@register("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(read(spark, folder, "documents"), rewrite=repeated_tail)
    # The longest run, of equal ones the first, then that of the least period.
    best = F.aggregate(F.col("runs"), F.get("runs", F.lit(0)), lambda best, r: F.when(
        (r["length"] > best["length"]), r).otherwise(best))
    told = found.withColumn("best", best)
    return told.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"),
                       F.col("best.length").alias("length"), F.col("best.period").alias("period"),
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
