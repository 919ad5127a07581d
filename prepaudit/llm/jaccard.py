"""Near copies by a prefix join over word shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prepaudit.llm.kernel import binaries, lists, mix, ordered, row_numbers, row_sets, shingles, texts_to_words
from prepaudit.llm.shared import broadcast_if_small, components, read, register, store

COMMON_SHINGLES = 1 << 20
BINS_PER_OCTAVE = 8
#: Shingles are counted by their first bits, in slices of bins.
COUNT_BITS, SLICE_BITS = 24, 14
#: A bin met less often than this is not common.
LEAST_COMMON = 16
PAIRS_AT_A_TIME = 500
#: Sets that share a shingle all meet if they are no more than this.
MOST_MEET = 32
SKETCH = [f"s{i}" for i in range(8)]
ROWS_AT_A_TIME = 1024
REACH = 16


def prefix_size(n, least: Fraction):
    """Shingles of a set of ``n`` of which a partner at similarity ``least`` must share one: n - ceil(least * n) + 1."""
    return n + (-(least.numerator * n) // least.denominator) + 1


def digests(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's set, in two halves."""
    some = np.diff(bounds) > 0
    halves = []
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        sums = np.zeros(len(some), np.uint64)
        if some.any():
            sums[some] = np.add.reduceat(mix(values * np.uint64(factor)), bounds[:-1][some])
        halves.append(mix(sums).view(np.int64))
    return halves[0], halves[1]


def sketches(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For each row the parities of its values by their last 9 bits, in eight longs."""
    bits, parts = 64 * len(SKETCH), [np.zeros((0, len(SKETCH)), np.int64)]
    for first in range(0, len(bounds) - 1, ROWS_AT_A_TIME):
        own = bounds[first:first + ROWS_AT_A_TIME + 1]
        last = (values[own[0]:own[-1]] & np.uint64(bits - 1)).astype(np.int64)
        counts = np.bincount(row_numbers(own) * bits + last, minlength=(len(own) - 1) * bits)
        parts.append(np.packbits((counts & 1).astype(np.uint8)).view(np.int64).reshape(-1, len(SKETCH)))
    return list(np.ascontiguousarray(np.concatenate(parts).T))


def levels(values: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """0 for values that are not common, else a step of their count, 255 at the utmost."""
    if not len(common):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(common, values), len(common) - 1)
    step = np.minimum(255, np.log2(counts) * BINS_PER_OCTAVE).astype(np.int64)
    return np.where(common[at] == values, step[at], 0)


def first_of(values: np.ndarray, bounds: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``kept`` values of each row, and their bounds."""
    out = np.concatenate([[0], np.cumsum(kept)])
    return values[np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], kept)], out


def _sets(width: int, least: Fraction, shared):
    """Map texts to shingle sets: size, 128-bit digest, sketch, the prefix, and how many at its end may be in more than ``MOST_MEET`` sets."""
    often = int(np.log2(MOST_MEET) * BINS_PER_OCTAVE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        for batch in batches:
            for first, end, words, word_bounds in texts_to_words(batch.column(1)):
                values, bounds = row_sets(*shingles(words, word_bounds, width))
                n = np.diff(bounds)
                halves = digests(values, bounds)
                step = steps[values >> np.uint64(64 - COUNT_BITS)].astype(np.int64)
                order, kept = ordered(values, row_numbers(bounds), step), np.where(n > 0, prefix_size(n, least), 0)
                prefix, out = first_of(values[order], bounds, kept)
                hot = np.append(0, np.cumsum(first_of(step[order] >= often, bounds, kept)[0]))[out]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(n.astype(np.int64)), *map(pa.array, halves),
                     pa.array(np.diff(hot).astype(np.int32)), *map(pa.array, sketches(values, bounds)), lists(prefix, out)],
                    ["id", "n", "d1", "d2", "hot", *SKETCH, "prefix"])
    return run


def _count(width: int):
    """Occurrences of shingles by bin, a row per slice of bins that a task met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((1 << (COUNT_BITS - SLICE_BITS), 1 << SLICE_BITS), np.uint32)
        for batch in batches:
            for _, _, words, bounds in texts_to_words(batch.column(0)):
                values = row_sets(*shingles(words, bounds, width))[0]
                np.add.at(counts.reshape(-1), values >> np.uint64(64 - COUNT_BITS), np.uint32(1))
        for i in np.flatnonzero(counts.any(axis=1)).tolist():
            packed = pa.compress(counts[i].tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed], pa.binary())], ["slice", "counts"])
    return run


def _steps(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A slice's counts over all tasks, as steps."""
    total = np.zeros(1 << SLICE_BITS, np.uint64)
    for raw in table.column("counts"):
        total += np.frombuffer(pa.decompress(raw.as_buffer(), decompressed_size=4 << SLICE_BITS, codec="zstd"), np.uint32)
    step = np.minimum(255, np.log2(np.maximum(total, 1)) * BINS_PER_OCTAVE).astype(np.uint8)
    return pa.table({"slice": table.column("slice").slice(0, 1), "steps": pa.array([step.tobytes()], pa.binary())})


def _packed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, words, bounds in texts_to_words(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), binaries(
                    *row_sets(*shingles(words, bounds, width)))], ["id", "shingles"])
    return run


def _verified(least: Fraction):
    """Keep the pairs whose sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, PAIRS_AT_A_TIME) for b in batches for i in range(0, b.num_rows, PAIRS_AT_A_TIME)):
            sides = []
            for c in (2, 3):
                column = batch.column(c)
                sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1])
                raw = column.buffers()[2]
                start = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset]) // 8
                values = np.frombuffer(raw, np.uint64)[start:start + int(sizes.sum()) // 8]
                sides.append((values, sizes // 8))
            values = np.concatenate([s[0] for s in sides])
            rows = np.concatenate([np.repeat(np.arange(len(s[1])), s[1]) for s in sides])
            order = ordered(values, rows)
            values, rows = values[order], rows[order]
            same = (values[1:] == values[:-1]) & (rows[1:] == rows[:-1])
            shared = np.bincount(rows[1:][same], minlength=len(batch))
            union = sides[0][1] + sides[1][1] - shared
            good = pa.array(shared * least.denominator >= union * least.numerator)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])
    return run


def _typed(docs: DataFrame, key: str, ddl: str) -> str:
    return ddl.replace("KEY", docs.schema[key].dataType.simpleString())


def common_values(counted: DataFrame, value: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (ascending) and counts of the most frequent rows of ``(value, n)`` that are met twice, ``most`` at the utmost.

    The cut is at a count, so nothing is sorted, and what reaches the driver has a fixed bound.
    """
    binned = counted.withColumn("bin", F.floor(F.log2("n") * BINS_PER_OCTAVE).cast("int"))
    total, cut = 0, None
    for row in sorted(binned.groupBy("bin").count().collect(), reverse=True):  # some hundred bins
        total += row["count"]
        if total > most or row["bin"] == 0:
            break
        cut = row["bin"]
    if cut is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = binned.filter(F.col("bin") >= cut).select(value, "n").toArrow()
    values, n = table[value].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(values)
    return values[order], n[order]


def common_shingles(docs: DataFrame, width: int, most: int) -> np.ndarray:
    """For every bin of shingles the step of its count over all texts, ``(id, text)``; 0 where it is not common.

    At most ``most`` bins are common beside those met ``MOST_MEET`` times and more. A task holds and sends one counter per bin, and a byte per bin reaches the driver, however many texts there are.
    """
    steps = np.zeros((1 << (COUNT_BITS - SLICE_BITS), 1 << SLICE_BITS), np.uint8)
    found = docs.select("text").mapInArrow(_count(width), "slice int, counts binary").groupBy("slice").applyInArrow(_steps, "slice int, steps binary")
    for row in found.collect():
        steps[row["slice"]] = np.frombuffer(row["steps"], np.uint8)
    at_least = np.cumsum(sum(np.bincount(s, minlength=256) for s in steps)[::-1])[::-1]  # bins at this step or above
    cut = min(int(np.log2(MOST_MEET) * BINS_PER_OCTAVE),
              max(int(np.log2(LEAST_COMMON) * BINS_PER_OCTAVE), int(np.count_nonzero(at_least > most))))
    steps[steps < cut] = 0
    return steps.reshape(-1)


def _field(of: str) -> Callable[[str], Column]:
    return lambda name: F.col(f"{name}{of}")


def _alike(least: Fraction, a=_field("a"), b=_field("b")) -> Column:
    """Sketches differ in no more bits than the sets differ in shingles, so this loses no pair."""
    apart = sum(F.bit_count(a(c).bitwiseXOR(b(c))) for c in SKETCH)
    return apart * (least.denominator + least.numerator) <= (a("n") + b("n")) * (least.denominator - least.numerator)


def _close(least: Fraction, a=_field("a"), b=_field("b")) -> Column:
    """Length and positional filter of two postings."""
    num, den, na, nb = least.numerator, least.denominator, a("n"), b("n")
    left = 1 + F.least(na - 1 - a("at"), nb - 1 - b("at"))
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (left * (den + num) >= (na + nb) * num)


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("shingle", *[F.col(c).alias(f"{c}{name}") for c in rows.columns if c != "shingle"])


def candidate_pairs(postings: DataFrame, least: Fraction) -> DataFrame:
    """Pairs ``(ga, gb)`` of sets whose postings ``(g, n, at, shingle)`` meet and pass the length and the positional filter."""
    # The smaller set comes first, so a pair appears once, and a partner is at most 1 / least times as large.
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("ga") < F.col("gb")))
    return _side(postings, "a").join(_side(postings, "b"), "shingle").filter(ordered & _close(least)).select("ga", "gb").distinct()


def neighbours(postings: DataFrame, least: Fraction) -> DataFrame:
    """Pairs ``(ga, gb)`` of each posting with the nearest two that may be similar, of the ``REACH`` before it in its shingle and slice and the first.

    Sorted slices ignore where a shingle ends, so a very common one spreads over many tasks; as the slices of the two orders
    differ, one links what the other has cut. This only saves work: ``open_pairs`` gives all pairs that are left.
    """
    found, packed = [], F.struct(*[c for c in postings.columns if c != "shingle"])
    for order in ([F.col("n"), F.col("g")], [F.xxhash64("g"), F.col("g"), F.col("n")]):
        sliced = postings.repartitionByRange(F.col("shingle"), *order).withColumn("slice", F.spark_partition_id())
        along = Window.partitionBy("slice", "shingle").orderBy(*order)
        met = sliced.withColumns({"before": F.collect_list(packed).over(along.rowsBetween(-REACH, -1)), "leader": F.first(packed).over(along)})
        near = F.filter(F.concat(F.reverse("before"), F.array("leader")), lambda x: (x["g"] != F.col("g")) & _close(least, x.getField, F.col)
                        & _alike(least, x.getField, F.col))
        found.append(met.select(F.explode(F.slice(near, 1, 2)).alias("x"), F.col("g").alias("gb")).select(F.col("x.g").alias("ga"), "gb"))
    return found[0].unionByName(found[1]).distinct()


def open_pairs(postings: DataFrame, tops: DataFrame, least: Fraction) -> DataFrame:
    """Pairs ``(ga, gb)`` of postings that meet, pass all filters and do not hang together by ``tops`` yet."""
    of = tops.select(F.col("id").alias("g"), "component")
    placed = store(postings.join(broadcast_if_small(store(of)), "g", "left").withColumn("top", F.coalesce("component", "g")).drop("component"))
    mixed = store(placed.groupBy("shingle").agg(F.min("top").alias("low"), F.max("top").alias("high"))
                  .filter(F.col("low") != F.col("high")).select("shingle"))
    rest = placed.join(broadcast_if_small(mixed), "shingle", "left_semi")
    a, b = _side(rest, "a"), _side(rest, "b")
    apart = (a["shingle"] == b["shingle"]) & (F.col("ga") < F.col("gb")) & (F.col("topa") != F.col("topb"))
    return a.join(b, apart & _close(least) & _alike(least)).select("ga", "gb").distinct()


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5,
                least: Fraction = Fraction(8, 10), share: int = 1, most: int = COMMON_SHINGLES) -> DataFrame:
    """``(<key>, n_shingles, component_id)``, one row per input row.

    Words are runs of anything but ASCII white space with A-Z in lower case; a text's set holds its distinct
    runs of ``width`` words, and a shorter text's whole sequence. Two texts link if the Jaccard similarity of
    their sets is at least ``least``; the component is the least id reached over links.

    Shingles have one order, (step of the count, hash), rare ones first. All texts are counted (``share`` admits no other value than 1), by the
    first bits of a shingle's hash; any one order makes the prefix filter exact, so counts cost no link. Equal sets are one set from the
    start. Sets that share a prefix shingle meet under length and positional filters if ``MOST_MEET`` share it at the utmost. With a more
    frequent one they meet their neighbours first, and then only sets that do not hang together. What meets is compared by sketches,
    which rule a pair out but never a similar one, and verified on whole sets.

    Texts without words link with nothing. A null text counts as empty. A null id links with nothing and has a null component;
    rows that repeat an id are one document, linked through each of its texts. An empty table gives an
    empty table; other columns are ignored, whatever their names.
    """
    if share != 1:
        raise ValueError("all texts are counted")
    body = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(body, width, most))
    sets = store(body.mapInArrow(_sets(width, least, shared),
                                 _typed(body, "id", f"id KEY, n bigint, d1 bigint, d2 bigint, hot int, {', '.join(f'{c} bigint' for c in SKETCH)}, prefix array<bigint>")))
    some = sets.filter((F.col("n") > 0) & F.col("id").isNotNull())
    # Only ids move until the copies are known; prefixes stay where they are.
    copies = _all_but_first(some.select("id", "n", "d1", "d2"), ["n", "d1", "d2"])
    one = some.join(broadcast_if_small(copies.drop("head")), ["id", "n", "d1", "d2"], "left_anti").withColumnRenamed("id", "g")
    postings = one.select("g", "n", *SKETCH, (F.size("prefix") - F.col("hot")).alias("cold"), F.posexplode("prefix").alias("at", "shingle"))
    late = postings.filter(F.col("at") >= F.col("cold")).drop("cold")
    hot = store(late.groupBy("shingle").agg(F.count("*").alias("met")).filter(F.col("met") > MOST_MEET).select("shingle"))
    few = broadcast_if_small(hot)
    often = store(late.join(few, "shingle"))
    met = store(candidate_pairs(postings.select("g", "n", "at", "shingle").join(few, "shingle", "left_anti"), least))
    known = one.select("g", "n", *SKETCH)
    a, b = (known.select(*[F.col(c).alias(f"{c}{name}") for c in known.columns]) for name in ("a", "b"))
    pairs = met.join(a, "ga").join(b, "gb").filter(_alike(least)).select("ga", "gb").unionByName(neighbours(often, least))
    edges = verify(store(_sorted_pairs(pairs)), body, width, least)
    tops = components(edges)
    rest = store(_sorted_pairs(open_pairs(often, tops, least)))
    if not rest.isEmpty():
        edges = edges.unionByName(verify(rest, body, width, least))
        tops = components(edges)
    heads = copies.select(*[F.col(c).alias(f"__{c}") for c in ("id", "d1", "d2")], F.col("head"))
    mine = (F.col("id") == F.col("__id")) & (F.col("d1") == F.col("__d1")) & (F.col("d2") == F.col("__d2"))
    found = sets.select("id", "n", "d1", "d2").join(broadcast_if_small(heads), mine, "left").select(
        "id", "n", F.coalesce("head", "id").alias("rep"))
    return found.join(tops.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def _all_but_first(rows: DataFrame, same: list[str]) -> DataFrame:
    """The rows of ``(id, same...)`` whose id is not the least of its class, with that as ``head``."""
    classes = rows.groupBy(*same).agg(F.min("id").alias("head"), F.max("id").alias("top")).filter(F.col("head") != F.col("top"))
    return store(rows.join(broadcast_if_small(store(classes.drop("top"))), same).filter(F.col("id") != F.col("head")).distinct())


def _sorted_pairs(pairs: DataFrame) -> DataFrame:
    a, b = F.col(pairs.columns[0]), F.col(pairs.columns[1])
    return pairs.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def verify(candidates: DataFrame, body: DataFrame, width: int, least: Fraction) -> DataFrame:
    """The pairs ``(a, b)`` of ids whose texts, ``(id, text)``, are similar enough, on whole sets."""
    ids = store(candidates.select(F.col("a").alias("id")).unionByName(candidates.select(F.col("b").alias("id"))).distinct())
    packed = store(body.join(broadcast_if_small(ids), "id", "left_semi").mapInArrow(
        _packed(width), _typed(body, "id", "id KEY, shingles binary")))
    return store(verified_pairs(candidates, packed, least))


def verified_pairs(candidates: DataFrame, packed: DataFrame, least: Fraction) -> DataFrame:
    """The pairs ``(a, b)`` whose sets, ``(id, binary)``, reach the similarity."""
    name = packed.columns[1]
    both = (candidates.join(packed.select(F.col("id").alias("a"), F.col(name).alias("sa")), "a")
            .join(packed.select(F.col("id").alias("b"), F.col(name).alias("sb")), "b").select("a", "b", "sa", "sb"))
    return both.mapInArrow(_verified(least), _typed(packed, "id", "a KEY, b KEY")).distinct()


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component: the one with the least id; rows without an id stay."""
    found = near_copies(docs, key, text, **options).filter(F.col("component_id") != F.col(key)).select(F.col(key).alias("__id"))
    return docs.join(broadcast_if_small(store(found)), docs[key] == F.col("__id"), "left_anti")


@register("op1_ngram_jaccard")
def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(read(spark, folder, "documents"), width=3, least=Fraction(9, 10))
