"""Near-equal lines by an exact set-similarity join; later matches go."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prepaudit.llm.jaccard import BINS_PER_OCTAVE, common_values, digests, first_of, levels, prefix_size, verified_pairs
from prepaudit.llm.kernel import binaries, ordered, row_numbers, row_sets, slices, word_hashes, word_spans
from prepaudit.llm.shared import broadcast_if_small, read, register, store

LEAST = Fraction(8, 10)
LEAST_WORDS = 3
COMMON_WORDS = 1 << 19
HOT_LINES = 512
SKETCH_BITS = 128


def line_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, each line's row and number in its text, and the lines' distinct word hashes with bounds."""
    for first, end, data, offsets in slices(column):
        starts, ends, _ = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        breaks = np.flatnonzero(data == 10) + 1
        # A line begins at each text's start and behind each line feed.
        begins = np.concatenate([offsets[:-1], breaks])
        rows = np.concatenate([np.arange(end - first), np.searchsorted(offsets, breaks - 1, "right") - 1])
        order = np.lexsort((begins, rows))
        begins, rows = begins[order], rows[order]
        number = np.arange(len(rows)) - np.searchsorted(rows, rows)
        bounds = np.append(np.searchsorted(starts, begins), len(starts))
        values, bounds = row_sets(words, bounds)
        yield first, rows, number, values, bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, _, values, _ in line_sets(batch.column(0)):
            found, n = np.unique(values, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["word", "n"])


def common_words(docs: DataFrame, text: str, most: int = COMMON_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and line counts of the words found in most lines, ``most`` at the utmost."""
    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_count, "word bigint, n bigint")
    return common_values(store(counted.groupBy("word").agg(F.sum("n").alias("n"))), "word", most)


def describe(docs: DataFrame, key: str, text: str, least: Fraction, least_words: int, most: int = COMMON_WORDS) -> DataFrame:
    """One row per line of at least ``least_words`` distinct words: size, digest, bit sketch, and the rarest words."""
    shared = docs.sparkSession.sparkContext.broadcast(common_words(docs, text, most))
    hot_level = int(np.log2(HOT_LINES) * BINS_PER_OCTAVE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for batch in batches:
            for first, rows, number, values, bounds in line_sets(batch.column(1)):
                n = np.diff(bounds)
                some = np.flatnonzero(n >= least_words)
                line = row_numbers(bounds)
                halves = [d[some] for d in digests(values, bounds)]
                bit = (values >> np.uint64(57)).astype(np.int64)
                sketch = np.zeros((len(n), SKETCH_BITS), np.uint8)
                sketch[line, bit] = 1
                packed = np.packbits(sketch[some], axis=1).view(np.int64)
                kept = np.zeros(len(n), np.int64)
                kept[some] = prefix_size(n[some], least)
                level = levels(values, common, counts)
                order = ordered(values, line, level)
                ranked, out = first_of(values[order], bounds, kept)
                hot, _ = first_of(level[order] >= hot_level, bounds, kept)
                hot_before = np.concatenate([[0], np.cumsum(hot)])
                n_hot = (hot_before[out[1:]] - hot_before[out[:-1]])[some]
                out = np.append(out[:-1][some], out[-1])
                prefix = pa.ListArray.from_arrays(pa.array(out.astype(np.int32)), pa.array(ranked.view(np.int64).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + rows[some])), pa.array(number[some].astype(np.int32)),
                     pa.array(n[some].astype(np.int32)), *map(pa.array, halves), pa.array(packed[:, 0]), pa.array(packed[:, 1]), prefix,
                     pa.array(n_hot.astype(np.int32))],
                    ["id", "line", "n", "d1", "d2", "b1", "b2", "prefix", "hot"])
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(
        run, f"id {kind}, line int, n int, d1 bigint, d2 bigint, b1 bigint, b2 bigint, prefix array<int>, hot int")


def _close(x: str, y: str, least: Fraction) -> Column:
    """Length, positional and sketch filter of the postings ``x_*`` and ``y_*``.

    The sketches differ in no more bits than the sets differ in words, so none of the filters loses a pair.
    """
    num, den = least.numerator, least.denominator
    a, b = F.col(f"{x}_n"), F.col(f"{y}_n")
    left = 1 + F.least(a - 1 - F.col(f"{x}_at"), b - 1 - F.col(f"{y}_at"))
    apart = sum(F.bit_count(F.col(f"{x}_{c}").bitwiseXOR(F.col(f"{y}_{c}"))) for c in ("b1", "b2"))
    return ((F.least(a, b) * den >= F.greatest(a, b) * num) & (left * (den + num) >= (a + b) * num)
            & (apart * (den + num) <= (a + b) * (den - num)))


def candidates(x: DataFrame, y: DataFrame, least: Fraction) -> DataFrame:
    """Pairs ``(a, b)`` of digests whose postings share a word and pass the filters, a before b if the postings tell."""
    x, y = (p.select("word", *[F.col(c).alias(f"{s}_{c}") for c in p.columns if c != "word"]) for s, p in (("x", x), ("y", y)))
    order = "first" if "x_first" in x.columns else "d1"
    met = x.join(y, (x["word"] == y["word"]) & (F.col(f"x_{order}") < F.col(f"y_{order}")) & _close("x", "y", least))
    return met.select(F.col("x_d1").alias("a"), F.col("y_d1").alias("b")).distinct()


def neighbours(postings: DataFrame, least: Fraction) -> DataFrame:
    """Pairs ``(a, b)`` of each posting with the one before it and the first one among those of equal word and size.

    The postings are cut into sorted slices that ignore where a word ends, so a very common word spreads over many tasks. Only
    the first word and size of a slice can have begun earlier, so what is carried over is one row per slice at most.
    """
    names, group, order = ["d1", "n", "at", "b1", "b2"], ["word", "n"], ["first", "d1"]
    sliced = store(postings.repartitionByRange(*map(F.col, [*group, *order])).withColumn("slice", F.spark_partition_id()))
    packed, place = F.struct(*names), F.struct(*order)
    ends = sliced.groupBy(*group, "slice").agg(F.min_by(packed, place).alias("head"), F.max_by(packed, place).alias("tail"))
    over = Window.partitionBy(*group).orderBy("slice")
    carried = ends.select(F.col("word").alias("of_word"), F.col("n").alias("of_n"), F.col("slice").alias("of_slice"),
                          F.lag("tail").over(over).alias("tail"), F.first("head").over(over).alias("head")).filter("tail IS NOT NULL")
    along = Window.partitionBy("slice", *group).orderBy(*order)
    local = sliced.withColumns({"before": F.lag(packed).over(along), "leader": F.first(packed).over(along)})
    met = local.join(F.broadcast(carried), (F.col("slice") == F.col("of_slice")) & (F.col("word") == F.col("of_word"))
                     & (F.col("n") == F.col("of_n")), "left")
    met = met.select(F.explode(F.array(F.coalesce("before", "tail"), F.coalesce("head", "leader"))).alias("x"),
                     *[F.col(c).alias(f"y_{c}") for c in names])
    met = met.filter("x IS NOT NULL").select(*[F.col(f"x.{c}").alias(f"x_{c}") for c in names], *[f"y_{c}" for c in names])
    return met.filter((F.col("x_d1") != F.col("y_d1")) & _close("x", "y", least)).select(
        F.col("x_d1").alias("a"), F.col("y_d1").alias("b")).distinct()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, _, values, bounds in line_sets(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(digests(values, bounds)[0]), binaries(values, bounds)], ["id", "words"])


def _verified(given: DataFrame, distinct: DataFrame, pairs: DataFrame, least: Fraction) -> DataFrame:
    """The pairs of digests whose whole sets, read again from their first lines' texts, are similar enough."""
    pairs = store(pairs)
    ends = store(pairs.select(F.col("a").alias("d1")).unionByName(pairs.select(F.col("b").alias("d1"))).distinct())
    sources = store(distinct.join(broadcast_if_small(ends), "d1", "left_semi").select(F.col("first.id").alias("source")).distinct())
    packed = (given.join(broadcast_if_small(sources), F.col("id") == F.col("source"), "left_semi")
              .select("text").mapInArrow(_packed, "id bigint, words binary"))
    packed = store(packed.join(broadcast_if_small(ends), F.col("id") == F.col("d1"), "left_semi").dropDuplicates(["id"]))
    return store(verified_pairs(pairs, packed, least))


def later_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: Fraction = LEAST,
                least_words: int = LEAST_WORDS) -> DataFrame:
    """``(<key>, line, kept_<key>, kept_line)``: each line that goes, and an earlier line it matches.

    Lines are cut at line feeds and numbered from 0. A line is the set of its words (runs of anything but ASCII white
    space, A-Z in lower case); lines below ``least_words`` distinct words are left alone. Two lines match if the Jaccard
    similarity of their sets is at least ``least``. A line goes if any line before it, by (id, number), matches it.

    Equal sets are one set from the start. The words of a set are ordered by rarity, its first n - ceil(least n) + 1
    words are joined under positional, length and sketch filters, and the pairs are verified on whole sets. A word that many
    lines have first brings each line together with its neighbour and the first line only; as one match settles a line, only
    the lines that stay open then meet all lines with the word.

    Null texts have no lines, and lines of rows without an id neither go nor make others go. Rows that repeat id and text are
    the same lines. An empty table gives an empty table; other columns are ignored, whatever their names.
    """
    given = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).filter(F.col("id").isNotNull())
    rows = store(describe(given, "id", "text", least, least_words))
    same = ["n", "d1", "d2"]
    distinct = store(rows.groupBy(*same).agg(
        F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("size"),
        *[F.first(c).alias(c) for c in ("b1", "b2", "prefix", "hot")]))
    # A set can only match another one if one word more or less leaves them similar enough; shorter ones match equal sets alone.
    wide = F.col("n") * least.denominator >= (F.col("n") + 1) * least.numerator
    postings = distinct.filter(wide).select("d1", "n", "b1", "b2", "first", (F.size("prefix") - F.col("hot")).alias("cold"),
                               F.posexplode("prefix").alias("at", "word"))
    cold = postings.filter(F.col("at") < F.col("cold")).drop("cold", "first")
    hot = postings.filter(F.col("at") >= F.col("cold")).drop("cold")
    found = _verified(given, distinct, neighbours(hot, least), least)
    settled = store(found.select(F.col("b").alias("d1")).distinct())
    open_hot = hot.join(broadcast_if_small(settled), "d1", "left_anti")
    rest = candidates(cold, cold, least).unionByName(candidates(hot, open_hot, least)).distinct()
    links = found.unionByName(_verified(given, distinct, rest, least))
    at = distinct.select("d1", "first")
    placed = (links.join(at.select(F.col("d1").alias("a"), F.col("first").alias("of_a")), "a")
              .join(at.select(F.col("d1").alias("b"), F.col("first").alias("of_b")), "b"))
    earlier = store(placed.groupBy(F.when(F.col("of_a") < F.col("of_b"), F.col("b")).otherwise(F.col("a")).alias("later"))
                    .agg(F.min(F.least("of_a", "of_b")).alias("match")))
    moved = distinct.select(*same, "first", "size").join(
        broadcast_if_small(earlier), F.col("d1") == F.col("later"), "left").select(
        *same, F.coalesce("match", "first").alias("kept"), "size", "match").filter((F.col("size") > 1) | F.col("match").isNotNull())
    goes = rows.select("id", "line", *same).join(broadcast_if_small(store(moved.drop("size", "match"))), same)
    return goes.filter(F.struct("id", "line") != F.col("kept")).select(
        F.col("id").alias(key), "line", F.col("kept.id").alias(f"kept_{key}"), F.col("kept.line").alias("kept_line")).distinct()


def without_lines(docs: DataFrame, gone: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines of ``gone`` taken out of their texts; a null text stays null."""
    numbers = gone.groupBy(F.col(key).alias("__id")).agg(F.collect_set("line").alias("__lines"))
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.col("__lines"), i))
    joined = docs.join(numbers, docs[key] == numbers["__id"], "left")
    body = F.when(F.col("__lines").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text, body).drop("__id", "__lines")


@register("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return later_lines(read(spark, folder, "documents"), least_words=1)
