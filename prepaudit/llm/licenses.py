"""Licences by TF-IDF cosine of lines, word windows and whole texts to templates, and their inheritance along directories."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prepaudit.llm.kernel import PUNCTUATION, row_numbers, slices, word_hashes, word_spans
from prepaudit.llm.shared import broadcast_if_small, read, register, store

#: Short notices by licence name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
LEAST_COSINE = 0.75
FILE_SHARE = 0.3
LONG_WORDS = 64
STRIDES = 8


@cache
def whole_texts() -> dict[str, str]:
    """Whole licence texts by licence name, from the files beside this one."""
    files = resources.files("prepaudit.llm").joinpath("license_texts").iterdir()
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(files, key=lambda f: f.name) if f.name.endswith(".txt")}


def _lines(column: pa.Array):
    """First row, end row, word hashes, and the rows and word bounds of the lines."""
    for first, end, data, offsets in slices(column):
        starts, ends, _ = word_spans(data, offsets, PUNCTUATION)
        words = word_hashes(data, starts, ends, PUNCTUATION)
        breaks = np.flatnonzero(data == 10) + 1
        begins = np.concatenate([offsets[:-1], breaks])
        rows = np.concatenate([np.arange(end - first), np.searchsorted(offsets, breaks - 1, "right") - 1])
        order = np.lexsort((begins, rows))
        yield first, end, words, rows[order], np.append(np.searchsorted(starts, begins[order]), len(starts))


class Templates:
    """Term weights of the templates: terms in hash order, idf per term, one unit vector per template."""

    def __init__(self, texts: Mapping[str, str], whole: Mapping[str, str] | None = None):
        self.names = [*texts, *(whole or {})]
        self.notices = len(texts)
        given = [*texts.values(), *(whole or {}).values()]
        found = list(_lines(pa.array([" ".join(t.split()) for t in given], pa.string())))
        words = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.uint64)
        rows = np.concatenate([f[0] + f[3][row_numbers(f[4])] for f in found]) if found else np.zeros(0, int)
        self.terms, at = np.unique(words, return_inverse=True)
        self.counts = np.zeros((len(self.names), len(self.terms)))
        np.add.at(self.counts, (rows, at), 1.0)
        self.sizes = self.counts.sum(axis=1).astype(np.int64)
        self.weigh(np.zeros(len(self.terms), np.int64), 0)

    def weigh(self, texts_with: np.ndarray, texts: int) -> None:
        """Set idf = ln((1 + texts) / (1 + texts with the term)) + 1; other words count as met nowhere."""
        self.idf = np.log((1 + texts) / (1 + texts_with)) + 1
        self.unseen = float(np.log(1 + texts) + 1)
        raw = self.counts * self.idf
        self.unit = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)

    def place(self, words: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for other words."""
        if not len(self.terms):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def cosines(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best template and its cosine for each line; -1 and 0 for lines without any term."""
        lines = row_numbers(bounds)
        order = np.lexsort((words, lines))
        w, l = words[order], lines[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (l[1:] != l[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(w)))
        w, l = w[at], l[at]
        term = self.place(w)
        known = term >= 0
        weight = n * np.where(known, self.idf[term] if len(self.terms) else 0.0, self.unseen)
        norm = np.sqrt(np.bincount(l, weight * weight, len(bounds) - 1))
        best, score = np.full(len(bounds) - 1, -1), np.zeros(len(bounds) - 1)
        for i in range(len(self.names)):
            dot = np.bincount(l[known], weight[known] * self.unit[i][term[known]], len(bounds) - 1)
            cosine = dot / np.maximum(norm, 1e-12)
            better = cosine > score + 1e-12
            best[better], score[better] = i, cosine[better]
        return best, score


    def spans(self, words: np.ndarray, row_bounds: np.ndarray, lines: np.ndarray,
              least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end, best template and cosine of the spans of words that reach ``least``: lines, whole rows, and sliding windows.

        A window is as long as a template and stays in a row; it begins at every word, or for long templates at every eighth of
        its length. As a word that repeats only makes a span's norm greater, the sum over its places bounds the
        cosine from above, and only spans whose bound reaches ``least`` are compared.
        """
        term = self.place(words)
        known = np.flatnonzero(term >= 0)
        idf = np.full(len(words), self.unseen)
        idf[known] = self.idf[term[known]] if len(self.terms) else 0
        norms = np.concatenate([[0], np.cumsum(idf * idf)])
        sizes = np.diff(row_bounds)
        begins, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, size in enumerate(self.sizes):
            dot = np.zeros(len(words) + 1)
            dot[known + 1] = idf[known] * self.unit[i][term[known]]
            dot = np.cumsum(dot)
            stride = 1 if size < LONG_WORDS else int(size) // STRIDES
            counts = np.where((sizes >= size) & (size > 0), (sizes - size) // stride + 1, 0)
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            begin = np.concatenate([lines[:-1], row_bounds[:-1], np.repeat(row_bounds[:-1], counts) + at * stride])
            end = np.concatenate([lines[1:], row_bounds[1:], np.repeat(row_bounds[:-1], counts) + at * stride + size])
            bound = (dot[end] - dot[begin]) / np.sqrt(np.maximum(norms[end] - norms[begin], 1e-12))
            near = np.flatnonzero((bound >= least - 1e-6) & (end > begin))
            begins.append(begin[near])
            ends.append(end[near])
        both = np.unique(np.stack([np.concatenate(begins), np.concatenate(ends)]), axis=1)
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for begin, end in zip(*(np.array_split(x, int((both[1] - both[0]).sum()) // (1 << 20) + 1) for x in both)):
            bounds = np.concatenate([[0], np.cumsum(end - begin)])
            best, score = self.cosines(words[np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], end - begin)], bounds)
            hit = score >= least
            found = [np.concatenate([f, x[hit]]) for f, x in zip(found, (begin, end, best, score))]
        return tuple(found)


def _texts_with(templates: Templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(templates.terms), np.int64)
        texts = 0
        for batch in batches:
            texts += batch.num_rows
            for _, end, words, rows, bounds in _lines(batch.column(0)):
                term = templates.place(words)
                row = rows[row_numbers(bounds)]
                pairs = np.unique(row[term >= 0] * max(1, len(total)) + term[term >= 0])
                total += np.bincount(pairs % max(1, len(total)), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(total)), -1)), pa.array(np.append(total, texts))],
                                         ["term", "n"])
    return run


def own_licenses(docs: DataFrame, text: str = "text", templates: Mapping[str, str] = TEMPLATES,
                 least: float = LEAST_COSINE, whole: Mapping[str, str] | None = None) -> DataFrame:
    """``docs`` with ``own_license``, ``own_score`` and ``own_share``.

    Templates are short notices and ``whole`` licence texts (``whole_texts()`` if not given). Each line, each whole text and each
    window of a template's length is a sparse TF-IDF vector of its words (cut at punctuation, A-Z in lower case); idf comes from all
    texts. The best of them at cosine ``least`` or more gives the licence (of equal ones the first, then the first template), and its
    share of the text's words tells notices from licence files; it is 1 where the text as a whole matches a whole licence text. Null and empty texts
    have no licence: null, 0 and 0.
    """
    known = Templates(templates, whole_texts() if whole is None else whole)
    body = docs.select(F.col(text).cast("string").alias("text"))
    rows = body.mapInArrow(_texts_with(known), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}  # one row per template word
    known.weigh(np.array([found.get(i, 0) for i in range(len(known.terms))]), found.get(-1, 0))
    shared = docs.sparkSession.sparkContext.broadcast(known)
    given = docs.drop("own_license", "own_score", "own_share")
    at = len(given.columns)
    added = StructType.fromDDL("own_license string, own_score double, own_share double")
    schema = StructType([*given.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            names: list[str | None] = [None] * batch.num_rows
            scores, shares = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for first, end, words, line_rows, bounds in _lines(batch.column(at)):
                row_bounds = bounds[np.searchsorted(line_rows, np.arange(end - first + 1))]
                begin, stop, best, score = known.spans(words, row_bounds, bounds, least)
                mine = np.searchsorted(row_bounds, begin, "right") - 1
                for i in np.lexsort((best, begin, mine)):
                    row, low, high = first + mine[i], row_bounds[mine[i]], row_bounds[mine[i] + 1]
                    if score[i] > scores[row] + 1e-12:
                        names[row], scores[row] = known.names[best[i]], score[i]
                        shares[row] = max(shares[row] == 1, (stop[i] - begin[i]) / (high - low))
                    if best[i] >= known.notices and (begin[i], stop[i]) == (low, high):
                        shares[row] = 1
            fields = [batch.schema.field(i) for i in range(at)]
            arrays = [pa.array(names, pa.string()), pa.array(scores), pa.array(shares)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *arrays], schema=pa.schema(
                [*fields, ("own_license", pa.string()), ("own_score", pa.float64()), ("own_share", pa.float64())]))
    return given.withColumn("__body", F.col(text).cast("string")).mapInArrow(run, schema)


def directory(path: Column) -> Column:
    """What stands before the last slash; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """The folder itself, then its parents, the top (empty) last."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    size = F.size(parts)
    return F.transform(F.sequence(F.lit(0), size), lambda i: F.array_join(F.slice(parts, F.lit(1), size - i), "/"))


def scan(docs: DataFrame, path: str = "path", text: str = "text", file_share: float = FILE_SHARE, **options) -> DataFrame:
    """``docs`` with ``own_license``, ``own_score``, ``own_share``, ``license`` and ``license_folder``.

    A text without a licence of its own inherits that of the nearest directory above it that holds a licence file, a text that as a
    whole matches a licence text, or of which what matches is at least the share ``file_share``. Of several files in a directory the one
    with the highest cosine counts, then the least path, then the least licence name. ``license_folder`` is that directory,
    null where the licence is the text's own or there is none. A null path inherits nothing. Rows are kept as they
    are; an empty table gives an empty table.
    """
    marked = store(own_licenses(docs, text, **options).withColumn("__folder", directory(F.col(path))).drop(text))
    files = marked.filter(F.col("own_license").isNotNull() & (F.col("own_share") >= file_share) & F.col("__folder").isNotNull())
    of_folder = files.groupBy(F.col("__folder").alias("holder")).agg(
        F.min(F.struct(-F.col("own_score"), F.col(path), F.col("own_license").alias("name")))["name"].alias("found"))
    folders = marked.filter(F.col("__folder").isNotNull()).select("__folder").distinct()
    steps = folders.select("__folder", F.posexplode(ancestors(F.col("__folder"))).alias("up", "holder"))
    nearest = steps.join(broadcast_if_small(store(of_folder)), "holder").groupBy("__folder").agg(
        F.min(F.struct("up", "holder", "found")).alias("near"))
    joined = marked.join(broadcast_if_small(store(nearest.withColumnRenamed("__folder", "__at"))), F.col("__folder") == F.col("__at"), "left")
    inherits = F.col("own_license").isNull()
    return joined.withColumns({
        "license": F.coalesce("own_license", "near.found"),
        "license_folder": F.when(inherits, F.col("near.holder"))}).drop("__folder", "__at", "near")


@register("op9_license_scan")
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100), F.col("doc_id"))
    return scan(docs.select("doc_id", path.alias("path"), "text")).select(
        "doc_id", "path", "own_license", F.round("own_score", 6).alias("own_score"), "license", "license_folder")
