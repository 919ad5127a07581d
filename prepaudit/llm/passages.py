"""Fuzzy passages that repeat across documents, by collinear chains of shared k-mer seeds."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prepaudit.llm.decontaminate import best_segment
from prepaudit.llm.kernel import binaries, mix, row_numbers, shingles, texts_to_words
from prepaudit.llm.shared import broadcast_if_small, read, register, store

KMER = 6
WINDOW = 6
GAP_COST = 0.1
LEAST_SEEDS = 2
LEAST_MATCH = 20
LEAST_WORDS = 45
REACH = 32
BRIDGE = 3
MOST_MEET = 32
HOT_BITS = 25
GRAM = 20


def minimizers(hashes: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every ``window`` consecutive ones in a row; a shorter row gives its least.

    Rows that share ``window`` consecutive hashes share a place among them.
    """
    n = np.diff(bounds)
    if not len(hashes):
        return np.zeros(0, np.int64)
    # Padding each row's end with the greatest value keeps windows inside rows.
    spread = np.arange(len(hashes)) + np.repeat(np.arange(len(n)) * (window - 1), n)
    padded = np.full(len(hashes) + len(n) * (window - 1), np.iinfo(np.uint64).max)
    padded[spread] = hashes
    place = np.zeros(len(padded), np.int64)
    place[spread] = np.arange(len(hashes))
    rows = row_numbers(bounds)
    within = np.arange(len(hashes)) - bounds[:-1][rows]
    begins = spread[within <= np.maximum(n[rows] - window, 0)]
    size = len(padded) - window + 1
    least, picked = padded[:size].copy(), np.zeros(size, np.int32)
    for step in range(1, window):
        value = padded[step:step + size]
        picked[value < least] = step
        np.minimum(least, value, out=least)
    found = np.zeros(len(hashes), bool)
    found[place[begins + picked[begins]]] = True
    return np.flatnonzero(found)


def by_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Stable order by (row, value); one sort of packed keys does it, unless two different values agree in the bits that fit."""
    if not len(values):
        return np.zeros(0, np.int64)
    bits = max(1, int(rows.max()).bit_length())
    packed = (rows.astype(np.uint64) << np.uint64(64 - bits)) | (values >> np.uint64(bits))
    order = np.argsort(packed, kind="stable")
    packed, found = packed[order], values[order]
    return np.lexsort((values, rows)) if ((packed[1:] == packed[:-1]) & (found[1:] != found[:-1])).any() else order


def _seeds(kmer: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, words, word_bounds in texts_to_words(batch.column(1)):
                short = np.diff(word_bounds) < kmer
                hashes, bounds = shingles(words, word_bounds, kmer)
                at = minimizers(hashes, bounds, window)
                row = row_numbers(bounds)[at]
                at, row = at[~short[row]], row[~short[row]]
                place = at - bounds[row]
                order = by_row(hashes[at], row)  # places stay in order
                h, r = hashes[at][order], row[order]
                place = place[order]
                # Of places in a row, as in a run of one word, the first and the last count.
                joined = (h[1:] == h[:-1]) & (r[1:] == r[:-1]) & (place[1:] == place[:-1] + 1)
                kept = ~(np.append(False, joined) & np.append(joined, False))[:len(h)]
                h, r, place = h[kept], r[kept], place[kept]
                head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))[:len(h)])
                more = np.delete(place, head).astype(np.int32)
                bounds = np.append(head, len(h)) - np.arange(len(head) + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[head].view(np.int64)), batch.column(0).take(pa.array(first + r[head])),
                     pa.array(place[head].astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(more))],
                    ["seed", "id", "at", "more"])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by seed those whose seed comes again, and those with the first and the last seed."""
    first, ahead, open_row = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if open_row is None else [open_row, batch]).combine_chunks().to_batches()[0]
        seed = rows.column(0).to_numpy()
        first = seed[0] if first is None else first
        again = np.append(False, seed[1:] == seed[:-1])
        again[0] = seed[0] == ahead if ahead is not None else False
        kept = (again | np.append(again[1:], False) | (seed == first))[:-1]
        ahead = seed[-2] if len(seed) > 1 else ahead
        open_row = rows.slice(len(seed) - 1)
        yield rows.slice(0, len(seed) - 1).filter(pa.array(kept))
    if open_row is not None:
        yield open_row


def _point(x, y):
    return F.struct(x.alias("at"), y.alias("other_at"))


def _crossed(at: Column, more: Column, other_at: Column, other_more: Column) -> Column:
    """Points of two texts with a seed: all places of one meet the other's first one and the other way round, and both in their order."""
    return F.concat(F.transform(F.concat(F.array(at), more), lambda m: _point(m, other_at)),
                    F.transform(other_more, lambda o: _point(at, o)),
                    F.transform(F.slice(more, 1, F.least(F.size(more), F.size(other_more))), lambda m, i: _point(m, F.get(other_more, i))))


def linked(seeds: DataFrame, most: int = MOST_MEET) -> tuple[DataFrame, DataFrame]:
    """``(id, other, points)`` of texts that share a seed, and the seeds that more than ``most`` texts hold.

    All texts with a seed meet each other if they are ``most`` at the utmost, so rows grow with the texts. With a more frequent seed they
    meet two each (``linked_in_line``); ``linked_by_grams`` finds the equal passages of the others.
    """
    shared = store(seeds.repartition("seed").sortWithinPartitions("seed", "id", "at").mapInArrow(_shared, seeds.schema))
    hot = store(shared.groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("seed"))
    few = broadcast_if_small(hot)
    held = (shared.join(few, "seed", "left_anti").groupBy("seed").agg(F.collect_list(F.struct("id", "at", "more")).alias("held"))
            .filter(F.size("held") > 1).select(F.sort_array("held").alias("held")))
    each = held.select("held", F.posexplode("held").alias("i", "x")).select("x", F.explode(F.slice("held", F.lit(1), F.col("i"))).alias("y"))
    met = each.filter("x.id != y.id").select("x.id", F.col("y.id").alias("other"), _crossed(
        F.col("x.at"), F.col("x.more"), F.col("y.at"), F.col("y.more")).alias("points"))
    return met.unionByName(linked_in_line(shared.join(few, "seed", "left_semi"))), hot


def linked_in_line(seeds: DataFrame) -> DataFrame:
    """``(id, other, points)``: each text's places of a seed against those of the first text and of the text before it with that seed.

    Sorted slices ignore where a seed ends, so one that very many texts hold spreads over many tasks; what is carried over is
    one row per slice at most. A text's further places meet the other's first one and the other way round, and both in
    their order, so matches grow with the places, not with their pairs.
    """
    sliced = store(seeds.repartitionByRange("seed", "id", "at").withColumn("slice", F.spark_partition_id()))
    edge = sliced.groupBy(F.col("slice").alias("of")).agg(F.min("seed").alias("low"), F.max("seed").alias("high"))
    outer = sliced.join(F.broadcast(edge), (F.col("slice") == F.col("of")) & ((F.col("seed") == F.col("low")) | (F.col("seed") == F.col("high"))))
    first, whole, place = F.struct("id", "at"), F.struct("id", "at", "more"), F.struct("id", "at")
    ends = outer.groupBy("seed", "slice").agg(F.min(first).alias("head"), F.max_by(whole, place).alias("tail"))
    over = Window.partitionBy("seed").orderBy("slice")
    carried = ends.select(F.col("seed").alias("of_seed"), F.col("slice").alias("of"), F.lag("tail").over(over).alias("tail"),
                          F.first("head").over(over).alias("head")).filter("tail IS NOT NULL")
    along = Window.partitionBy("slice", "seed").orderBy("id", "at")
    local = sliced.withColumns({"before": F.lag(whole).over(along), "leader": F.first(first).over(along)})
    met = local.join(F.broadcast(carried), (F.col("slice") == F.col("of")) & (F.col("seed") == F.col("of_seed")), "left").select(
        "id", "at", "more", F.coalesce("before", "tail").alias("before"), F.coalesce("head", "leader").alias("leader"))

    to_first = F.transform(F.concat(F.array("at"), "more"), lambda m: _point(m, F.col("leader.at")))
    crossed = _crossed(F.col("at"), F.col("more"), F.col("before.at"), F.col("before.more"))
    both = F.array(F.struct(F.col("before.id").alias("other"), crossed.alias("points")),
                   F.struct(F.col("leader.id").alias("other"), F.when(F.col("leader.id") != F.col("before.id"), to_first).alias("points")))
    return met.filter("before IS NOT NULL").select("id", F.inline(both)).filter("points IS NOT NULL AND id != other")


def seed_bits(seeds: DataFrame) -> np.ndarray:
    """A flag for each value of the first ``HOT_BITS`` bits of seeds: 4 MB, however many seeds there are."""
    bit = F.shiftrightunsigned("seed", 64 - HOT_BITS)
    rows = seeds.groupBy(F.bitmap_bucket_number(bit + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit + 1)).alias("bits")).collect()
    flags = np.zeros(1 << HOT_BITS >> 3, np.uint8)
    for row in rows:
        at = (row.bucket - 1) * len(row.bits)
        flags[at:at + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return flags


def _grams(kmer: int, window: int, flags: Broadcast):
    """``(key, id, at, size)``: the runs of ``GRAM`` words that begin or end with a flagged seed, and longer ones short of the next such run."""
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, words, word_bounds in texts_to_words(batch.column(1)):
                hashes, bounds = shingles(words, word_bounds, kmer)
                at = minimizers(hashes, bounds, window)
                bit = (hashes[at] >> np.uint64(64 - HOT_BITS)).astype(np.int64)
                at = at[(flags.value[bit >> 3] >> (bit & 7) & 1) > 0]
                row = row_numbers(bounds)[at]
                place = at - bounds[row]
                step = np.where(row[1:] == row[:-1], np.diff(place), 2 * window)
                ahead, behind = (np.minimum(x, 2 * window) for x in (np.append(step, 2 * window), np.append(2 * window, step)))
                powers = np.cumprod(np.append(np.uint64(1), np.full(len(words), base)), dtype=np.uint64)
                sums = np.append(np.uint64(0), np.cumsum(words * powers[:-1], dtype=np.uint64))
                back = np.cumprod(np.append(np.uint64(1), np.full(len(words), inverse)), dtype=np.uint64)
                n, rows_of = np.diff(word_bounds), row_numbers(word_bounds)
                for more in range(2 * window if len(at) else 0):
                    size, right, left = GRAM + more, ahead > more, behind > more
                    begin = np.concatenate([place[right], place[left] + kmer - size])
                    rows = np.concatenate([row[right], row[left]])
                    inside = (begin >= 0) & (begin + size <= n[rows])
                    low = np.unique(word_bounds[rows[inside]] + begin[inside])
                    of = rows_of[low]
                    keys = mix((sums[low + size] - sums[low]) * back[low] + np.uint64(size))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), batch.column(0).take(pa.array(first + of)),
                         pa.array((low - word_bounds[of]).astype(np.int32)), pa.array(np.full(len(low), size, np.int32))],
                        ["key", "id", "at", "size"])
    return run


def linked_by_grams(given: DataFrame, hot: DataFrame, kmer: int = KMER, window: int = WINDOW) -> DataFrame:
    """``(id, other, points)``: texts that share a run of ``GRAM`` words and more at a seed of ``hot`` meet the first one with it.

    Runs that begin with a seed are ``GRAM`` words long, or longer by less than the way to the next flagged seed, ``2 * window`` at the
    utmost; runs that end with one likewise. So an equal passage ends with such a run, begins with one, and those between overlap:
    every word of it lies in a run that its text shares with the first text that holds it, whichever that is, and rows grow with the
    places. Of two other seeds in a row the texts with the passage meet anyway.
    """
    kind = given.schema["id"].dataType.simpleString()
    flags = given.sparkSession.sparkContext.broadcast(seed_bits(hot))
    grams = store(given.mapInArrow(_grams(kmer, window, flags), f"key bigint, id {kind}, at int, size int"))
    place = F.struct("id", "at")
    ends = grams.groupBy("key").agg(F.min(place).alias("head"), F.max(place).alias("tail")).filter("head.id != tail.id")
    met = grams.join(ends, "key").withColumn("to", F.when(F.col("id") != F.col("head.id"), F.col("head")).otherwise(F.col("tail")))
    last = F.col("size") - kmer
    return met.select("id", F.col("to.id").alias("other"), F.array(
        _point(F.col("at"), F.col("to.at")), _point(F.col("at") + last, F.col("to.at") + last)).alias("points"))


def chain(matches: Sequence[tuple[int, int]], kmer: int = KMER, gap_cost: float = GAP_COST) -> list[list[tuple[int, int]]]:
    """Disjoint collinear chains of ``(at, other_at)`` matches, best first.

    A chain scores ``kmer`` per match, less ``gap_cost`` per word between neighbours on either side. As that cost is a
    difference of coordinates, the best predecessor is a prefix maximum, which a Fenwick tree over the ranks of the second
    coordinate answers while the matches are met in the order of the first.
    """
    points = sorted(set(matches))
    ranks = sorted({o for _, o in points})
    size = len(ranks)
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)
    score, before = [0.0] * len(points), [-1] * len(points)
    i = 0
    while i < len(points):
        j = i
        while j < len(points) and points[j][0] == points[i][0]:  # equal first coordinates cannot follow one another
            at, other = points[j]
            best, k = (float("-inf"), -1), bisect_left(ranks, other)
            while k > 0:
                if tree[k] > best:
                    best = tree[k]
                k -= k & -k
            gain = best[0] - gap_cost * (at + other)
            score[j], before[j] = (kmer + gain, best[1]) if gain > 0 else (kmer, -1)
            j += 1
        for p in range(i, j):
            at, other = points[p]
            value, k = (score[p] + gap_cost * (at + other + 2 * kmer), p), bisect_left(ranks, other) + 1
            while k <= size:
                if value > tree[k]:
                    tree[k] = value
                k += k & -k
        i = j
    used, chains = [False] * len(points), []
    for p in sorted(range(len(points)), key=lambda p: (-score[p], p)):
        found = []
        while p >= 0 and not used[p]:
            used[p] = True
            found.append(points[p])
            p = before[p]
        if found:
            chains.append(found[::-1])
    return chains


def straight(bounds: np.ndarray, at: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points of each row in ascending order, once each, their bounds, and whether ``chain`` gives them as one chain.

    It does where all lie on one diagonal, so near to each other that every one of them adds to the score.
    """
    row = row_numbers(bounds)
    order = np.lexsort((other, at, row))
    row, points = row[order], np.stack([at[order], other[order]], axis=1).astype(np.int32)
    joined = row[1:] == row[:-1]
    once = np.append(True, ~joined | (points[1:] != points[:-1]).any(axis=1))[:len(row)]
    row, points = row[once], points[once]
    step = np.diff(points, axis=0)
    near = (step[:, 0] == step[:, 1]) & (2 * GAP_COST * (step[:, 0] - KMER) < KMER - GAP_COST)
    bent = np.bincount(row[1:][(row[1:] == row[:-1]) & ~near], minlength=len(bounds) - 1)
    return points, np.searchsorted(row, np.arange(len(bounds))), bent == 0


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chain: the two ids and the anchors, as int32 pairs."""
    for batch in batches:
        rows, anchors = [], []
        column = batch.column(2)
        offsets = column.offsets.to_numpy()
        at, other = (column.values.field(i).to_numpy()[offsets[0]:offsets[-1]] for i in (0, 1))
        points, bounds, whole = straight(offsets - offsets[0], at, other)
        for row in range(batch.num_rows):
            mine = points[bounds[row]:bounds[row + 1]]
            for found in [mine] if whole[row] else chain(list(map(tuple, mine.tolist()))):
                if len(found) >= LEAST_SEEDS:
                    rows.append(row)
                    anchors.append(np.array(found, np.int32))
        pick = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pick), batch.column(1).take(pick),
             pa.array([int(a[0, 0]) for a in anchors], pa.int32()), pa.array([int(a[-1, 0]) for a in anchors], pa.int32()),
             pa.array([int(a[0, 1]) for a in anchors], pa.int32()), pa.array([int(a[-1, 1]) for a in anchors], pa.int32()),
             pa.array([a.tobytes() for a in anchors], pa.binary())],
            ["id", "other", "first", "last", "other_first", "other_last", "anchors"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, words, bounds in texts_to_words(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), binaries(
                words.astype(np.uint32), bounds)], ["word_id", "words"])


def align(text: np.ndarray, other: np.ndarray, anchors: np.ndarray, kmer: int = KMER) -> tuple[np.ndarray, int, np.ndarray]:
    """Which words of ``text`` equal their counterpart along a chain: flags, place of the first, and the counterparts.

    A counterpart lies on the diagonal of the nearest anchors. Where that changes, one insertion or deletion is
    placed so that most words agree. Both ends reach as far as the texts given.
    """
    anchors = anchors.astype(np.int64)
    diagonals = anchors[:, 1] - anchors[:, 0]
    where = np.zeros(len(text), np.int64)
    where[:] = diagonals[0]
    for i in np.flatnonzero(np.diff(diagonals)):
        low, high = min(anchors[i, 0] + kmer, anchors[i + 1, 0]), anchors[i + 1, 0]
        x = np.arange(low, high)
        sums = []
        for d in (diagonals[i], diagonals[i + 1]):
            y = x + d
            inside = (y >= 0) & (y < len(other))
            equal = np.zeros(len(x), np.int64)
            equal[inside] = text[x[inside]] == other[y[inside]]
            sums.append(np.concatenate([[0], np.cumsum(equal)]))
        cut = low + int(np.argmax(sums[0] + sums[1][-1] - sums[1]))
        where[cut:] = diagonals[i + 1]
    x = np.arange(len(text))
    y = x + where
    inside = (y >= 0) & (y < len(other))
    equal = np.zeros(len(text), bool)
    equal[inside] = text[x[inside]] == other[y[inside]]
    return equal, 0, y


def segments(equal: np.ndarray, least: int = LEAST_MATCH) -> list[tuple[int, int]]:
    """All best segments (+1 per equal word, -2 per other word) that score ``least``, found from both sides of the best one."""
    found, open_parts = [], [(0, len(equal))]
    while open_parts:
        low, high = open_parts.pop()
        if high - low < least:
            continue
        start, end, score = best_segment(equal[low:high])
        if score >= least:
            found.append((low + start, low + end))
            open_parts += [(low, low + start), (low + end, high)]
    return sorted(found)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, spans = [], []
        for row, (begin, other_begin, anchors, text, other) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(2, 7)))):
            points = np.frombuffer(anchors, np.int32).reshape(-1, 2) - np.array([begin, other_begin], np.int32)
            equal, _, y = align(np.frombuffer(text, np.uint32), np.frombuffer(other, np.uint32), points)
            for start, end in segments(equal):
                rows.append(row)
                spans.append((begin + start, begin + end, other_begin + int(y[start]), other_begin + int(y[end - 1]) + 1))
        columns = np.array(spans, np.int32).reshape(-1, 4).T
        pick = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), *map(pa.array, columns)],
                                         ["id", "other", "start", "end", "other_start", "other_end"])


def aligned_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", kmer: int = KMER, window: int = WINDOW,
                  most: int = MOST_MEET) -> DataFrame:
    """``(id, start, end, other, other_start, other_end)``: aligned passages, in words, of texts that share seeds."""
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).filter(F.col("id").isNotNull())
    seeds = given.mapInArrow(_seeds(kmer, window), f"seed bigint, id {kind}, at int, more array<int>")
    met, hot = linked(seeds, most)
    pairs = met.unionByName(linked_by_grams(given, hot, kmer, window)).groupBy("id", "other").agg(F.flatten(F.collect_list("points")).alias("points")).filter(
        F.size("points") >= LEAST_SEEDS)
    chains = store(pairs.mapInArrow(_chains, f"id {kind}, other {kind}, first int, last int, other_first int, other_last int, "
                                             "anchors binary"))
    ids = store(chains.select("id").unionByName(chains.select(F.col("other").alias("id"))).distinct())
    words = store(given.join(broadcast_if_small(ids), "id", "left_semi")
                  .mapInArrow(_words, f"word_id {kind}, words binary")).dropDuplicates(["word_id"])

    def cut(first, last, begin):
        low = F.greatest(F.col(first) - REACH, F.lit(0))
        return low.alias(begin), F.substring("words", low * 4 + 1, (F.col(last) + kmer + REACH - low) * 4)
    begin, piece = cut("first", "last", "begin")
    one = chains.join(words, F.col("id") == F.col("word_id")).select(*chains.columns, begin, piece.alias("piece"))
    begin, piece = cut("other_first", "other_last", "other_begin")
    both = one.join(words, F.col("other") == F.col("word_id")).select(
        "id", "other", "begin", begin, "anchors", "piece", piece.alias("other_piece"))
    return both.mapInArrow(_align, f"id {kind}, other {kind}, start int, end int, other_start int, other_end int")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """``(<key>, start_word, end_word, n_words, partner_id, first_copy)``: passages that some other document holds, too.

    Words are runs of anything but ASCII white space, A-Z in lower case. Seeds are the least hashes of every
    ``window`` runs of ``kmer`` words, so an equal run of ``kmer + window - 1`` words always shares one. Matches of two documents
    are chained with gap costs, chains are aligned word by word, and the spans of a document that touch or lie ``BRIDGE`` words apart are
    joined. Passages of ``least_words`` words and more are given, for all documents that hold them. ``partner_id`` is the least
    id it was aligned with; ``first_copy`` tells that it is greater than the document's own.

    Rows without an id, null and empty texts have no passages; of rows that repeat an id, one is read for the alignment.
    Repeats within one document do not count. An empty table gives an empty table.
    """
    spans = store(aligned_spans(docs, key, text, **options))
    sides = spans.select("id", "start", "end", "other").unionByName(spans.select(
        F.col("other").alias("id"), F.col("other_start").alias("start"), F.col("other_end").alias("end"), F.col("id").alias("other")))
    # At most one row per word of a document is left before a document's spans come together.
    starts = sides.groupBy("id", "start").agg(F.max("end").alias("end"), F.min("other").alias("other"))
    along = Window.partitionBy("id").orderBy("start")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reached.isNull() | (F.col("start") > reached + BRIDGE), 1).otherwise(0)
    islands = starts.withColumn("opened", opened).withColumn("island", F.sum("opened").over(along))
    return (islands.groupBy("id", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"),
                                                F.min("other").alias("partner_id"))
            .withColumn("n_words", F.col("end_word") - F.col("start_word")).filter(F.col("n_words") >= least_words)
            .select(F.col("id").alias(key), "start_word", "end_word", "n_words", "partner_id",
                    (F.col("id") < F.col("partner_id")).alias("first_copy")))


@register("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(read(spark, folder, "documents"))
