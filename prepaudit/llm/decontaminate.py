"""Benchmark passages in training texts, found by spaced seeds and verified along their diagonal."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from prepaudit.llm.kernel import mix, row_numbers, salts, texts_to_words
from prepaudit.llm.shared import read, register, text_of

#: Word positions marked 1 must be equal, those marked 0 may differ.
MASKS = ("111111", "1110111", "11011011")
MISMATCH = 2
LEAST_SCORE = 10
LEAST_WORDS = 6
BLOCK_BYTES = 8 * 1024 * 1024
FILTER_BITS = 22
HIT = "struct<item:string,start:int,n_words:int,n_matched:int,item_start:int>"
HIT_ARROW = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("n_words", pa.int32()),
                                ("n_matched", pa.int32()), ("item_start", pa.int32())]))


def seeds(words: np.ndarray, bounds: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the words under the mask at every place where it fits into a row, and the places."""
    span = len(mask)
    fits = np.diff(bounds) - span + 1
    fits = np.maximum(fits, 0)
    out = np.concatenate([[0], np.cumsum(fits)])
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], fits)
    total = np.full(len(at), number, np.uint64)
    for j, factor in enumerate(salts(span, 47)):
        if mask[j] == "1":
            total += words[at + j] * factor
    return mix(total), at


def best_segment(equal: np.ndarray, mismatch: int = MISMATCH) -> tuple[int, int, int]:
    """``(start, end, score)`` of the segment with the greatest sum of +1 per equal and ``-mismatch`` per unequal word.

    Of several the first to end, and from its latest start, so both ends are equal words.
    """
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -mismatch))])
    lowest = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - lowest))
    score = int(sums[end] - lowest[end])
    start = int(np.flatnonzero(sums[:end + 1] == lowest[end])[-1])
    return start, end, score


class Block:
    """The seeds of some benchmark items in sorted order, with a bit filter before them."""

    def __init__(self, ids: Sequence[str | None], texts: Sequence[str | None], masks: Sequence[str] = MASKS):
        self.ids, self.masks = list(ids), list(masks)
        words, bounds = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for _, _, w, b in texts_to_words(pa.array(list(texts), pa.string())):
            words.append(w)
            bounds.append(b[1:] + bounds[-1][-1])
        self.words, self.bounds = np.concatenate(words), np.concatenate(bounds)
        rows = row_numbers(self.bounds)
        found = [seeds(self.words, self.bounds, m, i) for i, m in enumerate(self.masks)]
        keys = np.concatenate([k for k, _ in found])
        places = np.concatenate([p for _, p in found])
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], places[order]
        self.items = rows[self.places]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> dict[int, list[dict]]:
        """Verified overlaps by row; of one item in one row the best."""
        rows, places, item_places = [], [], []
        row_of = row_numbers(bounds)
        for number, mask in enumerate(self.masks):
            keys, at = seeds(words, bounds, mask, number)
            near = np.flatnonzero(self.filter[keys >> np.uint64(64 - FILTER_BITS)])
            low = np.searchsorted(self.keys, keys[near], "left")
            n = np.searchsorted(self.keys, keys[near], "right") - low
            first = np.repeat(np.cumsum(n) - n, n)
            which = np.repeat(low, n) + np.arange(int(n.sum())) - first
            places.append(np.repeat(at[near], n))
            item_places.append(self.places[which])
            rows.append(row_of[places[-1]])
        row, place, item_place = map(np.concatenate, (rows, places, item_places))
        if not len(row):
            return {}
        item = row_numbers(self.bounds)[item_place]
        offset = (place - bounds[row]) - (item_place - self.bounds[item])
        found: dict[int, list[dict]] = {}
        best: dict[tuple[int, int], tuple] = {}
        for r, i, d in np.unique(np.stack([row, item, offset]), axis=1).T.tolist():
            text, source = words[bounds[r]:bounds[r + 1]], self.words[self.bounds[i]:self.bounds[i + 1]]
            low, high = max(0, -d), min(len(source), len(text) - d)
            equal = text[low + d:high + d] == source[low:high]
            start, end, score = best_segment(equal)
            if score >= min(LEAST_SCORE, len(source)) and (r, i) not in best or score > best.get((r, i), (1 << 60,))[0]:
                best[r, i] = (score, low + d + start, end - start, int(equal[start:end].sum()), low + start)
        for (r, i), (_, start, n, matched, item_start) in sorted(best.items()):
            found.setdefault(r, []).append({"item": self.ids[i], "start": start, "n_words": n, "n_matched": matched,
                                            "item_start": item_start})
        return found


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id",
         item_text: str = "text", output: str = "hits", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``output``: an array of the benchmark overlaps of each text, best per item, empty if there is none.

    Words are compared in lower case. Fixed masks pick words at given distances and ignore those between them; equal seeds of a text and an item put
    them on a diagonal, along which words are compared in place. An overlap is the best segment of the diagonal at +1 per equal
    and -2 per substituted word. It counts from ``LEAST_SCORE`` on, and for a shorter item if all of it is
    there; items below ``LEAST_WORDS`` words have no seeds and never count. Positions are word numbers.

    The benchmark reaches the tasks in blocks of at most about ``block_bytes`` of text, so no broadcast grows with it,
    and a text meets all blocks; texts are never shuffled. Null and empty texts have no hits, a null item id gives a null
    ``item``, rows stay as they are, repeated or not; an empty benchmark marks nothing. A column already
    called ``output`` is replaced; other columns pass through, whatever their names.
    """
    given = docs.drop(output) if output in docs.columns else docs
    items = benchmark.select(F.col(item_key).cast("string").alias("id"), F.lower(text_of(item_text)).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    columns = [f"__hits{b}" for b in range(blocks)]
    marked = given
    for b, column in enumerate(columns):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).distinct()
        part = sorted(((r.id, r.text) for r in part.toLocalIterator()), key=lambda r: (r[0] is None, r))
        shared = docs.sparkSession.sparkContext.broadcast(Block([p[0] for p in part], [p[1] for p in part]))
        marked = _mark_block(marked, shared, text, column)
    kept = [F.col(f"`{c}`") for c in given.columns]
    return marked.select(*kept, F.concat(*columns).alias(output))


def _mark_block(docs: DataFrame, shared, text: str, column: str) -> DataFrame:
    inner = "__body"
    given = docs.withColumn(inner, F.lower(F.col(text).cast("string")))
    schema = StructType([*docs.schema.fields, StructField(column, StructType.fromDDL(f"x array<{HIT}>")[0].dataType)])
    at = len(docs.columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            hits: list[list] = [[] for _ in range(batch.num_rows)]
            for first, _, words, bounds in texts_to_words(batch.column(at)):
                for row, found in block.hits(words, bounds).items():
                    hits[first + row] = found
            fields = [batch.schema.field(i) for i in range(at)] + [pa.field(column, HIT_ARROW)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(hits, HIT_ARROW)], schema=pa.schema(fields))
    return given.mapInArrow(scan, schema)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark overlap; null and empty texts stay."""
    return mark(docs, benchmark, text, output="__hits", **options).filter(F.size("__hits") == 0).drop("__hits")


@register("op2_decontamination")
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = read(spark, folder, "documents"), read(spark, folder, "benchmark")
    marked = mark(docs.select("doc_id", "text"), benchmark)
    return marked.select("doc_id", F.explode("hits").alias("h")).select(
        "doc_id", F.col("h.item").cast("bigint").alias("item_id"), F.col("h.start").alias("start_word"),
        F.col("h.n_words").alias("n_words"), F.col("h.n_matched").alias("n_matched"), F.col("h.item_start").alias("item_start"))
