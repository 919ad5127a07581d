"""Ranked search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepaudit.llm import search
from prepaudit.llm.search import (Shard, _impacts, best_documents, block_of, build_index, joint_maxima, prefix_bounds,
                                  search_shard)

from tests.llm.brute import low

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(low(text))


def ranked(rows, items, top=20):
    counts = [(key, Counter(terms(text))) for key, text in rows]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for key, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(times * weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if c[t])
            if score > 0 and key is not None:
                scores.append((-score, key))
        out += [(item, i + 1, key, -score) for i, (score, key) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def odd_corpus(seed, n=250):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "世界", "Wort", "WORT", "a_b", "x-1", " "]
    share = [1 / (i + 1) for i in range(len(vocabulary))]

    def text(size):
        return rnd.choice([" ", ", ", "\n"]).join(rnd.choices(vocabulary, share, k=size))
    rows = [(i, text(rnd.randint(0, 40))) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(60)]  # copies: ties
    rows += [(3, "w1 w2 w2"), (3, "w1 w2 w2"), (None, "w5 w6 w7"), (None, None), (9000, None), (9001, ""), (9002, " .,! "), (-4, text(3000))]
    rnd.shuffle(rows)
    items = [(i, text(rnd.randint(0, 12))) for i in range(25)] + [(25, None), (26, ""), (27, "nowhere"), (None, "w3 w4"), (28, "w1 " * 30)]
    return rows, items


@pytest.fixture(scope="module")
def item_table(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id int, text string")


@pytest.mark.parametrize("shard_bytes, block_bytes", [(1 << 20, 1 << 22), (300, 200)])
def test_against_scoring_all(texts, clashing, item_table, shard_bytes, block_bytes):
    rows, items = odd_corpus(3)
    found = best_documents(clashing(texts(rows)).repartition(5), clashing(item_table(items)),
                           shard_bytes=shard_bytes, block_bytes=block_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in found.collect()], key=str) == ranked(rows, items)


def test_items_that_repeat_an_id_are_answered_each(texts, item_table):
    rows, _ = odd_corpus(4)
    items = [(1, "w3 w9"), (1, "w40 wort"), (1, "w3 w9")]
    found = best_documents(texts(rows), item_table(items), top=3)
    assert sorted([tuple(r) for r in found.collect()], key=str) == ranked(rows, items, 3)


def test_empty_tables(texts, item_table):
    assert best_documents(texts([]), item_table([(1, "w1")])).collect() == []
    assert best_documents(texts([(1, "w1")]), item_table([])).collect() == []


def test_every_document_is_indexed(texts):
    rows, _ = odd_corpus(5)
    shards = build_index(texts(rows).repartition(4)).collect()
    ids = [int(i) for s in shards for i, k in zip(np.frombuffer(s["ids"], np.int64), np.frombuffer(s["known"], bool)) if k]
    assert sorted(ids) == sorted(k for k, _ in rows if k is not None)
    assert sum(s["n_terms"] for s in shards) == sum(len(terms(t)) for _, t in rows)


def shards_of(texts, rows, items):
    index = build_index(texts(rows).coalesce(1), shard_bytes=2000)
    n_documents, n_terms = index.agg(F.sum("n_documents"), F.sum("n_terms")).first()
    asked = texts(items).select(F.col("doc_id").alias("item"), "text").mapInArrow(search._query_terms, "item bigint, words binary")
    queries = block_of(asked, index, n_documents)
    lists = index.mapInArrow(_impacts(queries, n_documents, n_terms), search.IMPACTS).collect()
    return queries, [Shard(r.asDict()) for r in lists]


def test_bounds_hold_and_pairs_tighten_them(texts):
    """No document exceeds a prefix's bound; with stored pairs bounds are never greater, and fewer documents are met."""
    rnd = random.Random(8)
    rows = [(i, " ".join([f"a{rnd.randrange(30)}", f"b{rnd.randrange(30)}", *rnd.choices(["c", "d", "e", "f"], k=rnd.randint(0, 3))])) for i in range(900)]
    items = [(i, f"a{i} b{(7 * i) % 30} c d") for i in range(30)]
    queries, shards = shards_of(texts, rows, items)
    met, lower = {True: 0, False: 0}, 0
    for q, (number, times) in enumerate(queries.of):
        best = {pairs: np.zeros(0, np.int64) for pairs in met}
        for shard in shards:
            place = np.searchsorted(shard.number, number)
            here = np.array([p < len(shard.number) and shard.number[p] == n for p, n in zip(place, number)], bool)
            bounds = {p: prefix_bounds(shard, queries, number[here], place[here], times[here], p) for p in met}
            score = np.zeros(len(shard.ids), np.int64)
            for k, (spot, many) in enumerate(zip(place[here], times[here])):
                documents, impacts = shard.postings(spot)
                score[documents] += many * impacts
                assert score.max() <= bounds[True][k + 1] <= bounds[False][k + 1]
                lower += bounds[True][k + 1] < bounds[False][k + 1]
            for pairs in met:
                least = int(best[pairs][4]) if len(best[pairs]) == 5 else 1
                found, scores, seen = search_shard(shard, queries, q, least, pairs)
                assert sorted(scores.tolist()) == sorted(score[score >= least].tolist())
                met[pairs] += seen
                best[pairs] = np.sort(np.append(best[pairs], scores))[::-1][:5]
        assert best[True].tolist() == best[False].tolist()
    assert lower > 100 and met[True] < met[False]


def test_joint_maxima():
    rng = np.random.default_rng(2)
    matrix = rng.integers(0, 9, (12, 40)) * (rng.random((12, 40)) < 0.3)
    number = np.array([n for n in range(12) if matrix[n].any()])
    size = (matrix[number] > 0).sum(axis=1)
    document = np.concatenate([np.flatnonzero(matrix[n]) for n in number])
    impact = np.concatenate([matrix[n][matrix[n] > 0] for n in number])
    pairs = np.array([(a, b) for a in range(12) for b in range(a + 1, 12)])
    pair, joint = joint_maxima(pairs, number, size, document, impact, 40)
    expected = {i: (matrix[a] + matrix[b])[(matrix[a] > 0) & (matrix[b] > 0)].max()
                for i, (a, b) in enumerate(pairs.tolist()) if ((matrix[a] > 0) & (matrix[b] > 0)).any()}
    assert dict(zip(pair.tolist(), joint.tolist())) == expected
