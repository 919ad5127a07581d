"""Ranked lexical search by MaxScore with bounds on pairs of terms.

* ``build_index``: each run of documents becomes one shard, with its terms, postings, frequencies and lengths. Every document is indexed.
* ``impact_lists``: with the corpus counts known, a shard's postings of the terms asked for become impacts, and for pairs of
  terms that lie next to each other in a query, in order of weight, the intersection's greatest impacts are stored.
* ``best_documents``: queries run over the shards. A prefix of the terms in order of weight whose combined bound is below the least of
  the best scores so far cannot bring up a new document, so only the other terms' lists are merged, and a document is dropped as soon as its
  score and the bound of the terms still open fall short. The bound of a prefix is the cheapest way to cover it with single terms
  and stored pairs, so it is never above the sum of the terms' own maxima.

Scores are whole numbers, so no order of summing changes them. Queries are answered in blocks of bounded size; the best documents of each task
are merged in two steps, so no query's candidates meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prepaudit.llm.kernel import PUNCTUATION, row_numbers, texts_to_words
from prepaudit.llm.shared import read, register, store

TOP = 20
SHARD_BYTES = 1024 * 1024
BLOCK_BYTES = 4 * 1024 * 1024
SALTS = 64
SCALE = 1_000_000_000


def _grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of rows that are equal in all columns."""
    size = len(columns[0])
    fresh = np.zeros(size, bool)
    fresh[:1] = True
    for values in columns:
        fresh[1:] |= values[1:] != values[:-1]
    head = np.flatnonzero(fresh)
    return head, np.diff(np.append(head, size))


INDEX = ("ids binary, known binary, lengths binary, n_documents bigint, n_terms bigint, terms binary, document_counts binary, documents binary, "
         "frequencies binary")


def _index(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0)
            ids, known = key.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(key.is_valid())
            for first, end, words, bounds in texts_to_words(batch.column(1), shard_bytes, PUNCTUATION):
                lengths = np.diff(bounds)
                row = row_numbers(bounds)
                order = np.argsort(words, kind="stable")
                term, row = words[order], row[order]
                posting, frequency = _grouped(term, row)
                term, row = term[posting], row[posting]
                head, count = _grouped(term)
                columns = [ids[first:end].tobytes(), known[first:end].tobytes(), lengths.astype(np.int64).tobytes(), int((lengths > 0).sum()),
                           int(lengths.sum()), term[head].tobytes(), count.astype(np.uint32).tobytes(), row.astype(np.uint32).tobytes(),
                           frequency.astype(np.uint32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], [c.split()[0] for c in INDEX.split(", ")])
    return run


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards of an inverted index over all rows, stored in the shared folder.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case, kept as 64-bit hashes. Null and empty
    texts have none. ``key`` must be an integer.
    """
    given = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return store(given.mapInArrow(_index(shard_bytes), INDEX))


class Queries(NamedTuple):
    """A block of queries: for each, its id, and its terms by number in order of weight with their repeats."""

    ids: pa.Array
    terms: np.ndarray       # hashes of the block's terms, ascending
    weights: np.ndarray
    of: list[tuple[np.ndarray, np.ndarray]]
    pairs: np.ndarray       # neighbouring terms, (lesser number, greater number), ascending


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, words, bounds in texts_to_words(batch.column(1), SHARD_BYTES, PUNCTUATION):
            raw = [words[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(raw, pa.binary())], ["item", "words"])


def _document_counts(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(terms), np.int64)
        for batch in batches:
            for known, many in zip(batch.column(0), batch.column(1)):
                held, many = np.frombuffer(known.as_buffer(), np.uint64), np.frombuffer(many.as_buffer(), np.uint32)
                at = np.searchsorted(held, terms)
                found = np.flatnonzero(at < len(held))
                found = found[held[at[found]] == terms[found]]
                counts[found] += many[at[found]]
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["term", "n"])
    return run


def block_of(items: DataFrame, index: DataFrame, n_documents: int) -> Queries:
    """Number and weigh the terms of a block of ``(item, words)`` rows by the documents that hold them."""
    asked = items.select("item", "words").toArrow()
    words = [np.frombuffer(w.as_buffer(), np.uint64) for w in asked.column("words")]
    terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
    held = np.zeros(len(terms), np.int64)
    counted = index.select("terms", "document_counts").mapInArrow(_document_counts(terms), "term bigint, n bigint")
    for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():  # no more rows than the block has terms
        held[r["term"]] = r["n"]
    weights = np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * int(n) + 1))) for n in held], np.int64)
    of, pairs = [], [np.zeros((0, 2), np.int64)]
    for w in words:
        number, times = np.unique(np.searchsorted(terms, w), return_counts=True)
        keep = weights[number] > 0
        order = np.lexsort((number[keep], weights[number[keep]]))
        number, times = number[keep][order], times[keep][order].astype(np.int64)
        of.append((number, times))
        pairs.append(np.sort(np.stack([number[:-1], number[1:]], 1), axis=1))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    return Queries(asked.column("item").combine_chunks(), terms, weights, of, pairs)


IMPACTS = "ids binary, known binary, term binary, counts binary, documents binary, impacts binary, pair binary, joint binary"


def _impacts(queries: Queries, n_documents: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                def column(name, kind):
                    return np.frombuffer(batch.column(name)[row].as_buffer(), kind)
                held, count = column("terms", np.uint64), column("document_counts", np.uint32).astype(np.int64)
                at = np.searchsorted(held, queries.terms)
                number = np.flatnonzero(at < len(held))
                number = number[held[at[number]] == queries.terms[number]]
                at = at[number]
                begin, size = (np.cumsum(count) - count)[at], count[at]
                inside = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
                document, tf = column("documents", np.uint32)[inside].astype(np.int64), column("frequencies", np.uint32)[inside].astype(np.int64)
                lengths = column("lengths", np.int64)
                m = 75 + 25 * lengths * n_documents // max(n_terms, 1)
                impact = np.repeat(queries.weights[number], size) * (SCALE * tf // (1000 * tf + 12 * m[document]))
                pair, joint = joint_maxima(queries.pairs, number, size, document, impact, len(lengths))
                columns = [batch.column("ids")[row].as_py(), batch.column("known")[row].as_py(), number.astype(np.uint32).tobytes(),
                           size.astype(np.uint32).tobytes(), document.astype(np.uint32).tobytes(), impact.tobytes(),
                           pair.astype(np.uint32).tobytes(), joint.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], [c.split()[0] for c in IMPACTS.split(", ")])
    return run


def joint_maxima(pairs: np.ndarray, number: np.ndarray, size: np.ndarray, document: np.ndarray, impact: np.ndarray,
                 n_documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs that some document of the shard holds, and the greatest sum of both impacts in one document."""
    none = np.zeros(0, np.int64)
    if not len(number) or not len(pairs):
        return none, none
    at = np.minimum(np.searchsorted(number, pairs), len(number) - 1)
    both = np.flatnonzero((number[at] == pairs).all(axis=1))
    if not len(both):
        return none, none
    a, b = at[both].T
    swap = size[a] > size[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)  # the shorter list is looked up in the longer
    begin, key = np.cumsum(size) - size, np.repeat(np.arange(len(number)), size) * n_documents + document
    which = np.repeat(np.arange(len(both)), size[a])
    inside = np.arange(len(which)) + np.repeat(begin[a] - (np.cumsum(size[a]) - size[a]), size[a])
    wanted = b[which] * n_documents + document[inside]
    found = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    hit = key[found] == wanted
    which, total = which[hit], impact[inside[hit]] + impact[found[hit]]
    if not len(which):
        return none, none
    head, _ = _grouped(which)
    return both[which[head]], np.maximum.reduceat(total, head)


class Shard:
    """Impacts of a shard by term number, their maxima, and the joint maxima of pairs."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        size = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.documents, self.impacts = np.frombuffer(row["documents"], np.uint32), np.frombuffer(row["impacts"], np.int64)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.number = np.frombuffer(row["term"], np.uint32).astype(np.int64)
        self.most = np.maximum.reduceat(self.impacts, self.begin) if len(size) else np.zeros(0, np.int64)
        self.pair, self.joint = np.frombuffer(row["pair"], np.uint32).astype(np.int64), np.frombuffer(row["joint"], np.int64)

    def postings(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.begin[place], self.end[place]
        return self.documents[low:high], self.impacts[low:high]


def prefix_bounds(shard: Shard, queries: Queries, number: np.ndarray, place: np.ndarray, times: np.ndarray, with_pairs: bool = True) -> list[int]:
    """Bound on what the first k of a query's terms add to any document, for all k.

    Each pair of neighbours counts as the greatest of either term alone and of both in one document; a repeat of a term adds its own maximum.
    """
    alone = (times * shard.most[place]).tolist()
    together: list[int | None] = [None] * max(0, len(alone) - 1)
    if with_pairs and len(together) and len(queries.pairs):
        low, high = np.minimum(number[:-1], number[1:]), np.maximum(number[:-1], number[1:])
        width = len(queries.terms)
        keys = queries.pairs[:, 0] * width + queries.pairs[:, 1]
        at = np.minimum(np.searchsorted(keys, low * width + high), len(keys) - 1)
        stored = keys[at] == low * width + high
        spot = np.minimum(np.searchsorted(shard.pair, at), max(0, len(shard.pair) - 1))
        met = stored & (shard.pair[spot] == at) if len(shard.pair) else np.zeros(len(at), bool)
        repeats = (times - 1) * shard.most[place]
        for i in np.flatnonzero(stored):
            joint = int(shard.joint[spot[i]] + repeats[i] + repeats[i + 1]) if met[i] else 0
            together[i] = max(joint, alone[i], alone[i + 1])
    bounds = [0]
    for i, own in enumerate(alone):
        best = bounds[i] + own
        if i and together[i - 1] is not None:
            best = min(best, bounds[i - 1] + together[i - 1])
        bounds.append(best)
    return bounds


def search_shard(shard: Shard, queries: Queries, query: int, least: int, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents of a shard (by place) that may score ``least`` or more with their scores, and how many documents were met."""
    number, times = queries.of[query]
    none = np.zeros(0, np.int64)
    if not len(number) or not len(shard.number):
        return none, none, 0
    place = np.minimum(np.searchsorted(shard.number, number), len(shard.number) - 1)
    here = shard.number[place] == number
    number, times, place = number[here], times[here], place[here]
    bounds = prefix_bounds(shard, queries, number, place, times, with_pairs)
    if bounds[-1] < least:
        return none, none, 0
    first = next(k for k in range(len(bounds)) if k == len(number) or bounds[k + 1] >= least)  # terms before it bring up no document
    score = np.zeros(len(shard.ids), np.int64)
    for k in range(first, len(number)):
        documents, impacts = shard.postings(place[k])
        score[documents] += times[k] * impacts
    met = np.flatnonzero(score)
    found, score = met, score[met]
    for k in range(first - 1, -1, -1):
        open_ = score + bounds[k + 1] >= least
        found, score = found[open_], score[open_]
        if not len(found):
            break
        documents, impacts = shard.postings(place[k])
        at = np.minimum(np.searchsorted(documents, found), len(documents) - 1)
        score = score + np.where(documents[at] == found, times[k] * impacts[at], 0)
    keep = (score >= least) & shard.known[found]
    return found[keep], score[keep], len(met)


def _search(queries: Queries, top: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries.of)
        least = [1] * len(queries.of)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard({name: batch.column(name)[row].as_buffer() for name in batch.schema.names})
                for q in range(len(queries.of)):
                    found, score, _ = search_shard(shard, queries, q, least[q])
                    if len(found):
                        ids, score = np.append(best[q][0], shard.ids[found]), np.append(best[q][1], score)
                        order = np.lexsort((ids, -score))[:top]
                        best[q] = (ids[order], score[order])
                        least[q] = int(score[order][-1]) if len(order) == top else 1
        query = np.repeat(np.arange(len(best)), [len(ids) for ids, _ in best])
        task = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(query), block)), pa.array(query), queries.ids.take(pa.array(query)), pa.array(np.full(len(query), task)),
             pa.array(np.concatenate([np.zeros(0, np.int64), *(ids for ids, _ in best)])),
             pa.array(np.concatenate([np.zeros(0, np.int64), *(score for _, score in best)]))],
            ["block", "query", "item", "task", "id", "score"])
    return run


def best_documents(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                   item_text: str = "text", shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(<item_key>, rank, <key>, score)``: the ``top`` highest-scoring documents above 0 for every item, ties by ascending id.

    A term weighs ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))``, with N the documents that hold a term at all, df those that hold this one. A document of
    n terms has ``m = 75 + 25 n N div L``, L being all terms, and scores ``w * (10^9 tf div (1000 tf + 12 m))`` for each of the item's
    terms, repeats included.

    Null and empty texts have no terms. Rows without an id count in N, L and df but are not returned; rows that repeat an id rank
    each by itself. Every row of ``items`` is answered by itself, also where ids repeat or lack; one without terms has no documents.
    Other columns are not read; an empty table on either side gives an empty table.
    """
    kind = items.schema[item_key].dataType.simpleString()
    index = build_index(docs, key, text, shard_bytes)
    n_documents, n_terms = (int(x or 0) for x in index.agg(F.sum("n_documents"), F.sum("n_terms")).first())
    asked = store(items.select(F.col(item_key).alias("item"), F.col(item_text).cast("string").alias("text"))
                  .mapInArrow(_query_terms, f"item {kind}, words binary"))
    n_blocks = max(1, math.ceil((asked.agg(F.sum(F.octet_length("words"))).first()[0] or 0) / block_bytes))
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(n_blocks)))
    answers = None
    for b in range(n_blocks):  # each of bounded size, whatever the number of queries
        queries = block_of(blocks.filter(F.col("block") == b), index, n_documents)
        lists = store(index.mapInArrow(_impacts(queries, n_documents, n_terms), IMPACTS))
        found = lists.mapInArrow(_search(queries, top, b), f"block bigint, query bigint, item {kind}, task bigint, id bigint, score bigint")
        answers = found if answers is None else answers.unionByName(found)
    by_score = [F.col("score").desc(), F.col("id")]
    for salt in (["task"], []):
        place = F.row_number().over(Window.partitionBy("block", "query", *salt).orderBy(*by_score))
        answers = answers.withColumn("rank", place).filter(F.col("rank") <= top)
    return answers.select(F.col("item").alias(item_key), "rank", F.col("id").cast(docs.schema[key].dataType).alias(key), "score")


RANKED_SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
items AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
totals AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS terms FROM words),
lengths AS (SELECT doc_id, 75 + (25 * count(*) * (SELECT docs FROM totals)) // (SELECT terms FROM totals) AS m FROM words GROUP BY doc_id),
weights AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM totals) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs GROUP BY term),
scores AS (
    SELECT i.item_id, t.doc_id, sum(i.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * l.m)))::BIGINT AS score
    FROM items i JOIN tfs t USING (term) JOIN weights w USING (term) JOIN lengths l ON l.doc_id = t.doc_id GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@register("op13_ranked_search", RANKED_SQL)
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return best_documents(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
