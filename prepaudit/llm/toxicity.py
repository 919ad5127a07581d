"""Toxicity by non-negative positive-unlabelled learning over word presence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from prepaudit.llm.kernel import (
    PUNCTUATION, binaries, prefix_hashes, row_numbers, row_sets_of, slices, word_hashes, word_spans,
)
from prepaudit.llm.shared import broadcast_if_small, read, register, store

MOST_POSITIVE = 3_000
MOST_UNLABELLED = 10_000
FEATURES = 384
LEAST_POSITIVE_TEXTS = 5
LEAST_Z = 3.0
PREFIX_BYTES = (4, 5, 6, 7)
COUNT_LEVELS = (1, 2, 4)
RATE_WORDS = 150
MEMBERS = 2
STEPS = 250
RATE = 0.05
RIDGE = 1e-3
THRESHOLD = 0.3
FILTER_BITS = 20
LEVELS = len(COUNT_LEVELS) + 1


def held_out(key: str, folds: int, fold: int) -> Column:
    """True for keys in the fold; a null key is in none."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, end row, hashes of words and word beginnings, their row numbers, and the rows' word counts.

    Words are cut at punctuation. Beginnings let a stem count whatever follows it.
    """
    for first, end, data, offsets in slices(column):
        starts, ends, bounds = word_spans(data, offsets, PUNCTUATION)
        rows = row_numbers(bounds)
        found = [(word_hashes(data, starts, ends, PUNCTUATION), rows)]
        for size in PREFIX_BYTES:
            hashes, which = prefix_hashes(data, starts, ends, size, PUNCTUATION)
            found.append((hashes, rows[which]))
        yield first, end, np.concatenate([h for h, _ in found]), np.concatenate([r for _, r in found]), np.diff(bounds)


def levels(features: np.ndarray, bits: np.ndarray, hashes: np.ndarray, rows: np.ndarray,
           sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, column)`` of the cells that are 1: per feature one column for each count reached, and one for its rate."""
    near = np.flatnonzero(bits[hashes >> np.uint64(64 - FILTER_BITS)]) if len(features) else np.zeros(0, np.int64)
    if not len(near):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(features, hashes[near]), len(features) - 1)
    hit = features[place] == hashes[near]
    pairs, n = np.unique(rows[near[hit]] * len(features) + place[hit], return_counts=True)
    row, feature = pairs // len(features), pairs % len(features)
    reached = [n >= level for level in COUNT_LEVELS] + [n * RATE_WORDS >= sizes[row]]
    return (np.concatenate([row[r] for r in reached]),
            np.concatenate([feature[r] * LEVELS + i for i, r in enumerate(reached)]))


def filter_bits(features: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[features >> np.uint64(64 - FILTER_BITS)] = True
    return bits


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either kind that hold a feature, summed over each run of rows."""
    for batch in batches:
        positive = np.array(batch.column(0).to_pylist(), bool)
        for first, end, hashes, rows, _ in parts(batch.column(1)):
            hashes, bounds = row_sets_of(hashes, rows, end - first)
            kinds = positive[first:end][row_numbers(bounds)]
            found, at = np.unique(hashes, return_inverse=True)
            n_p, n_u = np.bincount(at[kinds], minlength=len(found)), np.bincount(at[~kinds], minlength=len(found))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n_p), pa.array(n_u)],
                                             ["feature", "n_p", "n_u"])


def choose_features(sample: DataFrame, most: int = FEATURES) -> np.ndarray:
    """Words and beginnings whose share of positive texts is most significantly above their share of unlabelled ones."""
    sizes = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not sizes[0] or not sizes[1]:
        return np.zeros(0, np.uint64)
    counted = sample.select("positive", "text").mapInArrow(_count_texts, "feature bigint, n_p bigint, n_u bigint")
    counted = counted.groupBy("feature").agg(F.sum("n_p").alias("n_p"), F.sum("n_u").alias("n_u"))
    a, b = F.col("n_p") / sizes[0], F.col("n_u") / sizes[1]
    pooled = (F.col("n_p") + F.col("n_u")) / (sizes[0] + sizes[1])
    noise = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / sizes[0] + 1 / sizes[1]))
    best = (counted.filter(F.col("n_p") >= LEAST_POSITIVE_TEXTS).select("feature", ((a - b) / noise).alias("z"))
            .filter(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "feature").limit(most))
    return np.sort(np.array([r.feature for r in best.collect()], np.int64).view(np.uint64))


def fit_member(x_p: np.ndarray, x_u: np.ndarray, prior: float, mine: np.ndarray | None = None, steps: int = STEPS,
               rate: float = RATE, ridge: float = RIDGE) -> np.ndarray:
    """Logistic weights by Adam on the non-negative risk, over the unlabelled rows that ``mine`` marks.

    risk = prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]). Where the second part, an estimate of
    the risk on negatives, falls below zero, its gradient is turned round instead, which undoes overfitting.
    """
    w = np.zeros(x_p.shape[1], np.float32)
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m, v = np.zeros_like(w), np.zeros_like(w)
    shrink = np.full_like(w, ridge)
    shrink[-1] = 0

    share = np.full(len(x_u), 1 / len(x_u)) if mine is None else mine / mine.sum()
    share = share.astype(np.float32)

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        z_p, z_u = x_p @ w, x_u @ w
        s_p, s_u = sigmoid(z_p), sigmoid(z_u)
        negative = np.logaddexp(0, z_u) @ share - prior * np.logaddexp(0, z_p).mean()
        g_negative = x_u.T @ (s_u * share) - prior * (x_p.T @ s_p) / len(s_p)
        g_positive = prior * (x_p.T @ (s_p - 1)) / len(s_p)
        g = (g_positive + g_negative if negative >= 0 else -g_negative) + shrink * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        learn: Column | None = None, most_positive: int = MOST_POSITIVE,
        most_unlabelled: int = MOST_UNLABELLED) -> tuple[np.ndarray, np.ndarray]:
    """``(word hashes, weights of the members)``, learned from rows where ``learn`` holds.

    Positive are texts that some label row marks 1; unlabelled are texts of any kind, as the
    risk estimator asks for the mixture. The class prior is the share of texts marked 1 among labelled ones. At most
    ``most_positive`` and ``most_unlabelled`` texts, the first in the order of a hash of their id, are learned from; of each only
    the cells of the chosen features reach the one task that fits.

    Without positive or without any texts there are no words, and the members score the prior (0 without labels).
    """
    learn = F.lit(True) if learn is None else learn
    ids = docs.filter(learn & F.col(key).isNotNull()).select(key).distinct()
    marks = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(
        (F.max(label) == 1).alias("positive"))
    known = store(ids.join(marks, key, "left").withColumn("order", F.xxhash64(F.lit("toxicity"), key)))
    seen = known.agg(F.count("positive"), F.count_if("positive")).first()
    prior = seen[1] / seen[0] if seen[0] else 0.0
    chosen = store(
        known.filter("positive").orderBy("order", key).limit(most_positive).select(key, F.lit(True).alias("positive"))
        .unionByName(known.orderBy("order", key).limit(most_unlabelled).select(key, F.lit(False).alias("positive"))))
    texts = docs.filter(learn).select(key, F.col(text).cast("string").alias("text"))
    sample = store(texts.join(broadcast_if_small(chosen), key).select(key, "positive", "text"))
    features = choose_features(sample)
    bits = filter_bits(features)
    if not len(features):
        level = np.float32(np.log(prior / (1 - prior)) if 0 < prior < 1 else (30.0 if prior else -30.0))
        return features, np.array([[level]], np.float32)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, hashes, rows, sizes in parts(batch.column(2)):
                row, column = levels(features, bits, hashes, rows, sizes)
                order = np.lexsort((column, row))
                bounds = np.searchsorted(row[order], np.arange(end - first + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first),
                     binaries(column[order].astype(np.int32), bounds)], ["key", "positive", "cells"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((not p, str(k), w) for b in batches for k, p, w in zip(*(c.to_pylist() for c in b.columns)))
        x = np.zeros((len(rows), len(features) * LEVELS + 1), np.float32)
        for i, (_, _, w) in enumerate(rows):
            x[i, np.frombuffer(w, np.int32)] = 1.0
        x[:, -1] = 1.0
        n_positive = sum(not unlabelled for unlabelled, _, _ in rows)
        x_p, x_u, members = x[:n_positive], x[n_positive:], []
        for member in range(MEMBERS):
            # Each member sees its own nine tenths of the unlabelled texts.
            mine = (np.arange(len(x_u)) + member) % 10 != 0
            members.append(fit_member(x_p, x_u, prior, mine if mine.any() else None))
        yield pa.RecordBatch.from_arrays([pa.array([np.array(members, np.float32).tobytes()], pa.binary())], ["weights"])
    kind = docs.schema[key].dataType.simpleString()
    rows = sample.mapInArrow(cells, f"key {kind}, positive boolean, cells binary")
    weights = rows.coalesce(1).mapInArrow(train, "weights binary").first().weights
    return features, np.frombuffer(weights, np.float32).reshape(MEMBERS, -1)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with ``output``, the mean probability of the members over the whole text; empty and null texts get one too."""
    spark = docs.sparkSession
    features, weights = model
    shared = spark.sparkContext.broadcast((features, weights.astype(np.float64), filter_bits(features)))
    inner = "__body"
    given = docs.drop(output) if output in docs.columns else docs
    at = len(given.columns)
    schema = StructType([*given.schema.fields, StructField(output, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights, bits = shared.value
        for batch in batches:
            logits = np.tile(weights[:, -1], (batch.num_rows, 1))
            for first, _, hashes, rows, sizes in parts(batch.column(at)):
                row, column = levels(features, bits, hashes, rows, sizes)
                np.add.at(logits, first + row, weights[:, column].T)
            value = (1 / (1 + np.exp(-np.clip(logits, -30, 30)))).mean(axis=1)
            fields = [batch.schema.field(i) for i in range(at)] + [pa.field(output, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(value)], schema=pa.schema(fields))
    return given.withColumn(inner, F.col(text).cast("string")).mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                  threshold: float = THRESHOLD, learn: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that score below the threshold; clean, empty and null texts stay."""
    model = fit(docs, labels, key, text, learn=learn)
    return score(docs, model, text, "__score").filter(F.col("__score") < threshold).drop("__score")


@register("op3_toxicity")
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    aside = held_out("doc_id", 4, 2)
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, learn=~aside))
    return scored.select("doc_id", aside.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
