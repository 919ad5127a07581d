"""Deleted interpolation: n-gram estimates mixed by context-frequency buckets, with weights from held-out counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepaudit.llm.kernel import mix, texts_to_words
from prepaudit.llm.shared import read, register, store
from prepaudit.llm.toxicity import held_out

LEAST_SHARE = 1e-6
DELETED_FOLDS = 10
FREQUENCY_BUCKETS = 32
STEPS_PER_DECADE = 16
ROUNDS = 50
MOST_KEYS = 1 << 21
RUN_BYTES = 4 * 1024 * 1024
LEAST_PARTS = 256
PART_WORDS = 1 << 20
ORDERS = 3
#: Orders that are counted in one shuffle; its files are gone before the next one's come.
SHARED_SHUFFLES = ((0, 1), (2,))
BEGIN, END = np.uint64(1), np.uint64(2)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in ascending ``keys``, -1 where it is missing."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def framed(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a begin mark before and an end mark behind each row; row numbers; and what is a token, all but the begin marks."""
    n = np.diff(bounds)
    rows = np.repeat(np.arange(len(n)), n + 2)
    out = np.zeros(len(rows), np.uint64)
    edges = np.concatenate([[0], np.cumsum(n + 2)])
    token = np.ones(len(rows), bool)
    out[edges[:-1]], out[edges[1:] - 1] = BEGIN, END
    token[edges[:-1]] = False
    inner = token.copy()
    inner[edges[1:] - 1] = False
    out[inner] = words
    return out, rows, token


@dataclass
class Tables:
    """Frequent n-grams with their counts in all training texts (column 0) and in the kept ones (column 1).

    They give estimates on the driver. Weights and scores come from the counts of all n-grams (``resolved``), not from these.
    """

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    triples: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    n_words: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    n_pairs: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    n_triples: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(2))
    kinds: int = 0
    rare_kinds: int = 0
    least: float = 1.0
    weights: np.ndarray | None = None

    def places(self, sequence: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every position the places of its word, of the pair and of the triple that end there; -1 if not frequent."""
        word = _find(self.words, sequence)
        before = np.concatenate([[-1], word[:-1]])
        before[np.concatenate([[True], rows[1:] != rows[:-1]])[:len(rows)]] = -1
        pair = np.full(len(word), -1, np.int64)
        both = (word >= 0) & (before >= 0)
        pair[both] = _find(self.pairs, before[both] * len(self.words) + word[both])
        pair_before = np.concatenate([[-1], pair[:-1]])
        pair_before[before < 0] = -1
        triple = np.full(len(word), -1, np.int64)
        whole = (word >= 0) & (pair_before >= 0) & (pair >= 0)
        triple[whole] = _find(self.triples, pair_before[whole] * len(self.words) + word[whole])
        return word, pair, triple

    def missing(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Share of each frequent word's, and pair's, followers that are too rare to be kept."""
        def share(n, keys, counts):
            owned = np.bincount(keys // max(1, len(self.words)), counts, len(n)) if len(keys) else np.zeros(len(n))
            return np.clip(1 - owned / np.maximum(n, 1e-9), 0, 1)
        return (share(self.n_words[:, which], self.pairs, self.n_pairs[:, which]),
                share(self.n_pairs[:, which], self.triples, self.n_triples[:, which]))

    def estimates(self, sequence: np.ndarray, rows: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each position's context, and its estimates of order 0 to 3.

        What an order's kept n-grams leave over goes to the order below, so each order is a distribution of its own. A word that
        is not frequent has an equal part of what all such words, and one that stands for unknown words, have together.
        """
        word, pair, triple = self.places(sequence, rows)
        before = np.concatenate([[-1], word[:-1]])
        pair_before = np.concatenate([[-1], pair[:-1]])
        head = np.concatenate([[True], rows[1:] != rows[:-1]])[:len(rows)]
        before[head], pair_before[head] = -1, -1
        n1, n2, n3 = self.n_words[:, which], self.n_pairs[:, which], self.n_triples[:, which]
        total = max(self.tokens[which], 1e-9)
        begin = _find(self.words, np.array([BEGIN]))[0]
        common = n1.sum() - (n1[begin] if begin >= 0 else 0)
        rare = max(0.0, 1 - common / total) / (self.rare_kinds + 1)

        def pick(values, at):
            return np.where(at >= 0, values[at], 0.0) if len(values) else np.zeros(len(at))
        p0 = np.full(len(word), 1 / (self.kinds + 1))
        p1 = np.where(word >= 0, pick(n1, word) / total, rare)
        lost1, lost2 = self.missing(which)
        c1, c2 = pick(n1, before), pick(n2, pair_before)
        p2 = np.where(c1 > 0, pick(n2, pair) / np.maximum(c1, 1e-9) + pick(lost1, before) * p1, p1)
        p3 = np.where(c2 > 0, pick(n3, triple) / np.maximum(c2, 1e-9) + pick(lost2, pair_before) * p2, p2)
        seen1, seen2 = pick(self.n_words[:, 0], before), pick(self.n_pairs[:, 0], pair_before)

        def bucket(c):
            return np.clip(np.floor(np.log2(np.maximum(c / self.least, 1))), 0, FREQUENCY_BUCKETS - 1).astype(np.int64)
        kind = np.where(seen2 > 0, 1 + FREQUENCY_BUCKETS + bucket(seen2), np.where(seen1 > 0, 1 + bucket(seen1), 0))
        return kind, np.stack([p0, p1, p2, p3])


def fit_weights(kind: np.ndarray, p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights per bucket by expectation-maximisation over cells of (bucket, estimates) met ``n`` times.

    A bucket without held-out tokens gets equal weights.
    """
    weights = np.full((1 + 2 * FREQUENCY_BUCKETS, 4), 0.25)
    for b in np.unique(kind):
        mine = kind == b
        q, m, w = p[:, mine], n[mine].astype(float), weights[b]
        for _ in range(rounds):
            share = w[:, None] * q
            share /= share.sum(axis=0)
            w = (share * m).sum(axis=1) / m.sum()
        weights[b] = np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()
    return weights


def _counted(training: DataFrame, keys: Callable) -> DataFrame:
    """``(key, n, k)``: how often training texts, and the kept ones, hold a key; a task sums up to ``MOST_KEYS`` keys before it sends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merge():
            key = np.concatenate([h[0] for h in held])
            found, at = np.unique(key, return_inverse=True)
            return [(found, *(np.bincount(at, np.concatenate([h[i] for h in held]), len(found)).astype(np.int64) for i in (1, 2)))]

        def rows():
            key, n, k = held.pop()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(k)], ["key", "n", "k"])
        size = 0
        for batch in batches:
            kept = np.array(batch.column(1).to_pylist(), bool)
            for first, _, words, bounds in texts_to_words(batch.column(0)):
                key, row = keys(*framed(words, bounds))
                found, at = np.unique(key, return_inverse=True)
                ones = np.bincount(at, minlength=len(found))
                held.append((found.view(np.int64), ones, np.bincount(at, kept[first + row], len(found)).astype(np.int64)))
                size += len(found)
                if size > MOST_KEYS:
                    held = merge()
                    size = len(held[0][0])
                    if size > MOST_KEYS // 2:
                        yield rows()
                        size = 0
        if held:
            held = merge()
            yield rows()
    return (training.select("text", "kept").mapInArrow(run, "key bigint, n bigint, k bigint")
            .groupBy("key").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))


def _table(counted: DataFrame, least: float, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Keys (ascending) and counts of what is met ``least`` times; at most tokens / least rows."""
    rows = counted.filter(F.col("n") >= least).select("key", "n", "k").toArrow()
    keys = rows["key"].to_numpy().view(kind)
    order = np.argsort(keys)
    return keys[order], np.stack([rows["n"].to_numpy(), rows["k"].to_numpy()], axis=1).astype(float)[order]


def ngrams(sequence: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order the positions where an n-gram ends inside a row, and the n-grams' keys."""
    inside = np.zeros(len(sequence), bool)
    inside[1:] = rows[1:] == rows[:-1]
    whole = inside.copy()
    whole[1:] &= inside[:-1]
    two, three = np.flatnonzero(inside), np.flatnonzero(whole)
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    pair = np.zeros(len(sequence), np.uint64)
    pair[two] = mix(mix(sequence[two - 1] + a) * b + sequence[two])
    return [(np.arange(len(sequence)), sequence), (two, pair[two]), (three, mix(mix(pair[three - 1] + b) * a + sequence[three]))]


def exact_estimates(counts: np.ndarray, rows: np.ndarray, total: float, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each position's context, and its estimates of order 0 to 3, from the counts of its word, pair and triple.

    A context that was never met leaves the estimate to the order below, so each order is a distribution of its own.
    """
    n1, n2, n3 = counts.astype(float)
    c1, c2 = np.zeros(len(rows)), np.zeros(len(rows))
    c1[1:], c2[1:] = n1[:-1], n2[:-1]
    head = np.ones(len(rows), bool)
    head[1:] = rows[1:] != rows[:-1]
    c1[head], c2[head] = 0, 0
    p0 = np.full(len(rows), 1 / (kinds + 1))
    p1 = n1 / total if total > 0 else p0
    p2 = np.where(c1 > 0, n2 / np.maximum(c1, 1), p1)
    p3 = np.where(c2 > 0, n3 / np.maximum(c2, 1), p2)

    def bucket(c):
        return np.minimum(np.floor(np.log2(np.maximum(c, 1))), FREQUENCY_BUCKETS - 1).astype(np.int64)
    kind = np.where(c2 > 0, 1 + FREQUENCY_BUCKETS + bucket(c2), np.where(c1 > 0, 1 + bucket(c1), 0))
    return kind, np.stack([p0, p1, p2, p3])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of texts: ids, flags (1 training, 2 kept, 4 scored), words as numbers in the run's vocabulary, bounds."""
    for batch in batches:
        flags = sum(np.array(batch.column(i).to_pylist(), np.uint8) << (i - 2) for i in (2, 3, 4))
        for first, end, words, bounds in texts_to_words(batch.column(1), RUN_BYTES):
            vocabulary, numbers = np.unique(words, return_inverse=True)
            mine = flags[first:end]
            lengths = np.diff(bounds) + 1
            tokens = [int(lengths[(mine & f) > 0].sum()) for f in (1, 2)]
            ids = batch.column(0).slice(first, end - first)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *([pa.array([_packed(x)], pa.binary()) for x in (
                    mine, bounds.astype(np.int64), np.diff(vocabulary, prepend=np.uint64(0)), numbers.astype(np.uint32))]),
                 *[pa.array([t], pa.int64()) for t in (len(words) + len(ids), *tokens)]],
                ["ids", "flags", "bounds", "vocabulary", "numbers", "size", "n", "k"])


def _opened(flags: bytes, bounds: bytes, vocabulary: bytes, numbers: bytes, wanted: tuple[int, ...] = tuple(range(ORDERS))):
    """A run's framed words, their rows, what is a token, flags by row, and per wanted order ``(positions, keys, places, n, k)``."""
    vocabulary, = _unpacked(vocabulary, np.uint64)
    numbers, = _unpacked(numbers, np.uint32)
    flag, = _unpacked(flags, np.uint8)
    bounds, = _unpacked(bounds, np.int64)
    sequence, rows, token = framed(np.cumsum(vocabulary, dtype=np.uint64)[numbers], bounds)
    orders = []
    found_by_order = ngrams(sequence, rows)
    for at, keys in (found_by_order[i] for i in wanted):
        found, place = np.unique(keys, return_inverse=True)
        mine = flag[rows[at]]
        orders.append((at, found, place, *(np.bincount(place, (mine & f) > 0, len(found)).astype(np.int64) for f in (1, 2))))
    return sequence, rows, token, flag, orders


def _part_bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the ascending keys of each of ``2**bits`` parts by their first bits begin, and the end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, compressed: the bytes of their numbers by place, so that those which are zero throughout cost nothing."""
    raw = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes() for x in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes, *kinds) -> list[np.ndarray]:
    kinds = [np.dtype(kind) for kind in kinds]
    size = int.from_bytes(packed[:8], "little")
    raw = np.frombuffer(pa.decompress(memoryview(packed)[8:], size, codec="zstd", asbytes=True), np.uint8)
    planes = raw.reshape(sum(kind.itemsize for kind in kinds), -1) if size else raw.reshape(sum(kind.itemsize for kind in kinds), 0)
    out = []
    for kind in kinds:
        out.append(np.ascontiguousarray(planes[:kind.itemsize].T).view(kind).ravel())
        planes = planes[kind.itemsize:]
    return out


def _dealt(bits: int, wanted: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *packed in zip(*(batch.column(c).to_pylist() for c in ("slice", "flags", "bounds", "vocabulary", "numbers"))):
                for order, (_, keys, _, n, k) in zip(wanted, _opened(*packed, wanted)[4]):
                    edges = _part_bounds(keys, bits)
                    parts = np.flatnonzero(np.diff(edges))
                    steps = np.diff(keys, prepend=np.uint64(0))  # keys ascend, so a part needs its first one and the steps
                    steps[edges[parts]] = keys[edges[parts]]
                    columns = steps, n.astype(np.uint32), (n - k).astype(np.uint32)
                    blobs = pa.array([_packed(*(x[edges[p]:edges[p + 1]] for x in columns)) for p in parts], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((parts + (order << bits)).astype(np.int32)), pa.array(np.full(len(parts), name, np.int64)), blobs],
                        ["part", "slice", "counts"])
    return run


REPLY = "slice bigint, part int, kinds bigint, counts binary"


def _totals(bits: int):
    """What a part's n-grams count over all runs, for each run that lacks some of it; under slice -1 the number of training words."""
    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        keys, n, rest = zip(*(_unpacked(x, np.uint64, np.uint32, np.uint32) for x in table["counts"].to_pylist()))
        keys = [np.cumsum(x, dtype=np.uint64) for x in keys]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
        keys, n, rest = map(np.concatenate, (keys, n, rest))
        k = n - rest
        found, at = np.unique(keys, return_inverse=True)
        sums = [np.bincount(at, x, len(found)).astype(np.int64) for x in (n, k)]
        open_at = np.flatnonzero((sums[0][at] != n) | (sums[1][at] != k))
        cuts = np.searchsorted(open_at, edges)
        names = table["slice"].to_pylist()
        out = []
        for i in np.flatnonzero(np.diff(cuts)):
            mine = open_at[cuts[i]:cuts[i + 1]]
            places = np.diff(mine - edges[i], prepend=0).astype(np.uint32)
            total, kept = (x[at[mine]] for x in sums)
            out.append((names[i], None, _packed(places, total, total - kept)))
        if part >> bits == 0:
            kinds = np.count_nonzero((sums[0] > 0) & (found != BEGIN))
            out.append((-1, int(kinds), None))
        columns = list(zip(*out)) or [()] * 3
        return pa.table({"slice": pa.array(columns[0], pa.int64()), "part": pa.array([part] * len(out), pa.int32()),
                         "kinds": pa.array(columns[1], pa.int64()), "counts": pa.array(columns[2], pa.binary())})
    return run


def _settled(bits: int, kept_tokens: int):
    """A run with all counts: per position of its scored rows those of word, pair and triple; and the deleted rows' cells."""
    def run(given: pa.Table, replies: pa.Table) -> pa.Table:
        packed = [given[c][0].as_py() for c in ("flags", "bounds", "vocabulary", "numbers")]
        sequence, rows, token, flag, orders = _opened(*packed)
        edges = [_part_bounds(o[1], bits) for o in orders]
        for part, counts in zip(*(replies[c].to_pylist() for c in ("part", "counts"))):
            order = part >> bits
            places, n, rest = _unpacked(counts, np.uint32, np.int64, np.int64)
            place = edges[order][part & ((1 << bits) - 1)] + np.cumsum(places, dtype=np.int64)
            orders[order][3][place], orders[order][4][place] = n, n - rest
        scored, deleted = (flag & 4) > 0, ((flag & 3) == 1)[rows]

        def at_positions(column, wanted):
            counts = np.zeros((ORDERS, np.count_nonzero(wanted)), np.int64)
            for i, order in enumerate(orders):
                full = np.zeros(len(sequence), np.int64)
                full[order[0]] = order[column][order[2]]
                counts[i] = full[wanted]
            return counts
        kind, p = exact_estimates(at_positions(4, deleted), rows[deleted], kept_tokens, 0)
        kind, p = kind[token[deleted]], p[:, token[deleted]]
        steps = np.round(np.log10(np.maximum(p[1:], 1e-30)) * STEPS_PER_DECADE).astype(np.int64)
        cell, m = np.unique(np.concatenate([kind[None], steps]), axis=1, return_counts=True)
        ids = given["ids"].combine_chunks().flatten().filter(pa.array(scored))
        lengths = np.bincount(rows, minlength=len(flag))[scored]
        counts = at_positions(3, scored[rows])
        cells = pa.StructArray.from_arrays([*map(pa.array, cell), pa.array(m)], ["kind", "s1", "s2", "s3", "n"])
        return pa.table({
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            "lengths": pa.array([_packed(lengths.astype(np.int64))], pa.binary()),
            **{f"n{i + 1}": pa.array([_packed(counts[i])], pa.binary()) for i in range(ORDERS)},
            "cells": pa.ListArray.from_arrays(pa.array([0, len(cells)], pa.int32()), cells)})
    return run


def resolved(rows: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """Runs of texts with the counts of all their n-grams in all training texts; training and kept tokens; training words.

    ``rows`` has ``id``, ``text``, ``learn``, ``kept`` and ``scored``. A run of about 4 MB of text counts its own words, pairs and
    triples, and sends each of them once to the part of its key's first bits, triples after the others. There the counts of all runs are added up. A run gets back
    only what other runs add to its own counts, so an n-gram that one run alone holds does not travel back, and a very
    common one moves once per run. Nothing is cut: every n-gram has its count.
    """
    kind = rows.schema["id"].dataType.simpleString()
    runs = rows.select("id", F.col("text").cast("string"), "learn", "kept", "scored").mapInArrow(
        _slices, f"ids array<{kind}>, flags binary, bounds binary, vocabulary binary, numbers binary, size bigint, n bigint, k bigint")
    runs = store(runs.withColumn("slice", F.monotonically_increasing_id()))
    size, *tokens = runs.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("size", "n", "k")]).first()
    bits = int(np.ceil(np.log2(max(LEAST_PARTS, size / PART_WORDS))))
    packed = runs.select("slice", "flags", "bounds", "vocabulary", "numbers")
    replies = None
    for wanted in SHARED_SHUFFLES:
        dealt = packed.mapInArrow(_dealt(bits, wanted), "part int, slice bigint, counts binary")
        found = store(dealt.groupBy("part").applyInArrow(_totals(bits), REPLY))
        replies = found if replies is None else replies.unionByName(found)
    kinds = replies.filter("slice = -1").agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    settled = runs.drop("size", "n", "k").groupBy("slice").cogroup(replies.filter("slice >= 0").groupBy("slice")).applyInArrow(
        _settled(bits, tokens[1]), f"ids array<{kind}>, lengths binary, n1 binary, n2 binary, n3 binary, "
                                   "cells array<struct<kind:bigint,s1:bigint,s2:bigint,s3:bigint,n:bigint>>")
    return store(settled), np.array(tokens, float), int(kinds)


def learned_weights(runs: DataFrame, kinds: int) -> np.ndarray:
    met = (runs.select(F.inline("cells")).groupBy("kind", "s1", "s2", "s3")
           .agg(F.sum("n").alias("n")).toArrow())  # bounded by the steps, not by the texts
    p = 10.0 ** (np.stack([met[s].to_numpy() for s in ("s1", "s2", "s3")]) / STEPS_PER_DECADE)
    p0 = np.full((1, len(met)), 1 / (kinds + 1))
    return fit_weights(met["kind"].to_numpy(), np.concatenate([p0, p]), met["n"].to_numpy())


def _scored(runs: DataFrame, key: str, kind: str, tokens: float, kinds: int, weights: np.ndarray) -> DataFrame:
    total = tokens + 0.5 * (kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0).slice(i, 1).flatten()
                lengths, *counts = (_unpacked(batch.column(j)[i].as_py(), np.int64)[0] for j in range(1, 5))
                n = len(lengths)
                rows = np.repeat(np.arange(n), lengths)
                context, p = exact_estimates(np.stack(counts), rows, tokens, kinds)
                token = np.ones(len(rows), bool)
                token[np.concatenate([[0], np.cumsum(lengths)])[:-1]] = False
                row, one = rows[token], counts[0][token]
                log_p = np.log10((weights[context[token]].T * p[:, token]).sum(axis=0))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(lengths - 1), pa.array(np.bincount(row, one > 0, n).astype(np.int64)),
                     pa.array(np.full(n, int(tokens))), pa.array(np.bincount(row, np.log10((one + 0.5) / total), n).astype(float)),
                     pa.array(np.bincount(row, log_p, n).astype(float))],
                    ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return runs.select("ids", "lengths", "n1", "n2", "n3").mapInArrow(
        run, f"id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").withColumnRenamed("id", key)


def kept_texts(key: str) -> Column:
    """Every tenth training text, by a hash of its id, is held out from the estimates behind the weights."""
    return F.pmod(F.xxhash64(F.lit("deleted"), key), F.lit(DELETED_FOLDS)) != 0


def fit_and_score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``score`` gives for ``docs`` after ``fit`` on its rows where ``learn`` holds, counting n-grams once for both."""
    learn = F.coalesce(learn, F.lit(False))
    runs, tokens, kinds = resolved(docs.select(
        F.col(key).alias("id"), F.col(text).alias("text"), learn.alias("learn"), (learn & kept_texts(key)).alias("kept"),
        F.lit(True).alias("scored")))
    return _scored(runs, key, docs.schema[key].dataType.simpleString(), tokens[0], kinds, learned_weights(runs, kinds))


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text",
        least_share: float = LEAST_SHARE) -> tuple[Tables, DataFrame]:
    """The model, and the training texts ``(text, kept)`` whose counts ``score`` looks up, learned from rows where ``learn`` holds.

    The weights are found by expectation-maximisation on the tokens of the training texts that ``kept_texts`` holds out, with the
    counts of all n-grams of the others, and then used with the counts of all training texts. The n-grams (up to three words,
    begin and end marks included) that make up ``least_share`` of the training tokens are collected besides, at most 1 / ``least_share``
    an order, for ``Tables.estimates``.
    """
    spark = docs.sparkSession
    training = docs.filter(learn).select(F.col(text).cast("string").alias("text"), kept_texts(key).alias("kept"))
    model = Tables()
    runs, model.tokens, model.kinds = resolved(training.select(
        F.lit(None).cast("bigint").alias("id"), "text", F.lit(True).alias("learn"), "kept", F.lit(False).alias("scored")))
    model.weights = learned_weights(runs, model.kinds)
    model.least = max(2.0, least_share * model.tokens[0])
    model.words, model.n_words = _table(_counted(training, lambda sequence, rows, token: (sequence, rows)), model.least, np.uint64)
    marks = int(BEGIN in model.words)
    model.rare_kinds = model.kinds - (len(model.words) - marks)
    shared = spark.sparkContext.broadcast(model)

    def pair_keys(sequence, rows, token):
        word = _find(shared.value.words, sequence)
        at = np.flatnonzero((word[1:] >= 0) & (word[:-1] >= 0) & (rows[1:] == rows[:-1]))
        return word[at] * len(shared.value.words) + word[at + 1], rows[at]
    model.pairs, model.n_pairs = _table(_counted(training, pair_keys), model.least)
    with_pairs = spark.sparkContext.broadcast(model)

    def triple_keys(sequence, rows, token):
        word, pair, _ = with_pairs.value.places(sequence, rows)
        at = np.flatnonzero((pair[1:] >= 0) & (pair[:-1] >= 0) & (rows[1:] == rows[:-1]))
        return pair[at] * len(with_pairs.value.words) + word[at + 1], rows[at]
    model.triples, model.n_triples = _table(_counted(training, triple_keys), model.least)
    return model, training


def score(docs: DataFrame, model: Tables, training: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(<key>, n_tokens, n_known, train_tokens, base_score, score)``, one row per input row.

    ``score`` is the log10 probability of the whole text under the mixture, its end included, with the counts of all n-grams of
    ``training``. ``base_score`` is that of single words with half a count added to each. A null or empty
    text is its end alone. Rows are never merged; an empty table gives an empty table; without training texts every
    probability is 1. Other columns are ignored, whatever their names.
    """
    kind = docs.schema[key].dataType.simpleString()
    asked = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"), F.lit(False).alias("learn"),
                        F.lit(False).alias("kept"), F.lit(True).alias("scored"))
    rows = asked.unionByName(training.select(
        F.lit(None).cast(kind).alias("id"), "text", F.lit(True).alias("learn"), "kept", F.lit(False).alias("scored")))
    runs, _, _ = resolved(rows)
    return _scored(runs, key, kind, float(model.tokens[0]), model.kinds, model.weights)


@register("op7_lm_scoring")
def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    aside = held_out("doc_id", 5, 1)
    return fit_and_score(docs, ~aside).select(
        "doc_id", aside.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
