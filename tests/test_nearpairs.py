"""Near copies against all pairs."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from prepaudit.operators import nearpairs
from prepaudit.operators.nearpairs import components, elements, near_classes, signature


def dice(a, b, n=5):
    x, y = (Counter(t[i:i + n] for i in range(len(t) - n + 1)) for t in (a, b))
    total = x.total() + y.total()
    return 2 * (x & y).total() / total if total else 1.0


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randint(3, 8))) for _ in range(400)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(30, 120))) for _ in range(60)]
    rows = list(enumerate(texts))
    for _ in range(90):  # edited copies, of copies as well
        words = rnd.choice(rows)[1].split(" ")
        for _ in range(max(1, int(len(words) * rnd.choice([0.01, 0.03, 0.06])))):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((len(rows), " ".join(words)))
    return rows


def tops(n, links):
    top = list(range(n))

    def find(v):
        while top[v] != v:
            v = top[v]
        return v
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return [find(v) for v in range(n)]


def test_recall_against_all_pairs(spark):
    rows = corpus(1)
    scores = {(i, j): dice(a, b) for (i, a), (j, b) in combinations(rows, 2)}
    true = [p for p, s in scores.items() if s >= 0.8]
    found = {r["doc"]: r for r in near_classes(spark.createDataFrame(rows, "doc int, body string").repartition(4), "doc", "body").collect()}
    together = [i in found and j in found and found[i]["class_id"] == found[j]["class_id"] for i, j in true]
    assert len(true) > 100 and np.mean(together) >= 0.95
    exact = tops(len(rows), true)
    assert all(exact[i] == exact[r["class_id"]] for i, r in found.items())  # and nothing else comes together
    for i, r in found.items():
        pair = tuple(sorted((i, r["class_id"])))
        assert r["similarity"] == pytest.approx(1.0 if i == r["class_id"] else scores[pair])


def test_copies_nulls_and_repeats(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(5, text), (3, text), (9, text + " x"), (9, text + " x"), (None, text), (1, None), (2, ""), (7, "abc"), (8, "abc"), (10, "zzz zzz zzz")]
    found = {r["doc"]: (r["class_id"], round(r["similarity"], 2)) for r in near_classes(spark.createDataFrame(rows, "doc int, body string"), "doc", "body").collect()}
    assert found == {3: (3, 1.0), 5: (3, 1.0), 9: (3, 0.98), 7: (7, 1.0), 8: (7, 1.0)}
    assert near_classes(spark.createDataFrame([], "doc int, body string"), "doc", "body").collect() == []


def test_a_large_group_lists_no_pairs(spark):
    """800 near copies of one text are compared with their least one, not with each other."""
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join([*words, f"n{i * i}"])) for i in range(800)]
    found = near_classes(spark.createDataFrame(rows, "doc int, body string"), "doc", "body")
    assert {r["class_id"] for r in found.collect()} == {0} and found.count() == 800


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 4000).astype(np.uint64)
    b = np.concatenate([a[:3000], rng.integers(0, 2**63, 1000).astype(np.uint64)])
    assert (signature(a, 2000) == signature(b, 2000)).mean() == pytest.approx(3000 / 5000, abs=0.06)
    assert (signature(a[:3], 64) == signature(a[:3][::-1], 64)).all()
    assert len(elements("aaaaaaa", 5)) == 3 == len(set(elements("aaaaaaa", 5).tolist())) and len(elements("ab", 5)) == 1


def test_components_of_a_chain_and_a_star(spark):
    links = [(i + 1, i) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(200, 200)]
    found = {r["id"]: r["least"] for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}, 200: 200}


def test_small_buckets_take_their_turns_at_once(spark, monkeypatch):
    """The same links and classes as one leader a round, from a number of rounds that does not follow the members of a small bucket."""
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdefgh") for _ in range(120)) for _ in range(6)]
    rows = []
    for i in range(90):
        letters = list(base[i % 6])
        for _ in range(rnd.randrange(12)):
            letters[rnd.randrange(120)] = rnd.choice("abcdefgh")
        rows.append((i, "".join(letters)))
    df, rounds, settle = spark.createDataFrame(rows, "id long, text string"), [], nearpairs.settle
    found = {}
    for small in (1, nearpairs.SMALL_BUCKET):
        kept = []
        monkeypatch.setattr(nearpairs, "SMALL_BUCKET", small)
        monkeypatch.setattr(nearpairs, "settle", lambda x: kept.append(x.columns) or settle(x))
        # coarse bands, so that texts that are not alike meet
        found[small] = sorted(map(tuple, nearpairs.near_classes(df, "id", "text", bands=4, rows=1).collect()))
        rounds.append(sum(c == ["bucket", "rep", "leader", "size"] for c in kept))
    assert found[1] == found[32] and len(found[1]) > 40
    assert rounds[1] < rounds[0]


def test_many_leaders_of_a_bucket_take_their_turns_at_once(spark, monkeypatch):
    """Texts that share a passage meet in large buckets without being alike; the number of rounds does not follow them."""
    rnd = random.Random(5)
    shared = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    texts = [" ".join([*shared, *(f"v{rnd.randrange(10**6)}" for _ in range(70))]) for _ in range(240)]
    rows = [*enumerate(texts), *((1000 + i, texts[i] + " x") for i in range(0, 240, 4))]
    kept, settle = [], nearpairs.settle
    monkeypatch.setattr(nearpairs, "settle", lambda x: kept.append(x.columns) or settle(x))
    found = near_classes(spark.createDataFrame(rows, "id int, text string").repartition(4), "id", "text", bands=6, rows=1).collect()
    assert sorted((r["id"], r["class_id"]) for r in found) == sorted((i + add, i) for i in range(0, 240, 4) for add in (0, 1000))
    assert sum(c == ["bucket", "rep", "leader", "size"] for c in kept) <= 5


def test_marks_rule_out_no_similar_pair():
    rng = np.random.default_rng(4)
    for size in (1, 7, 100, 1000, 20_000):
        for common, kept in ((0.8, True), (0.82, True), (0.5, size < 1000)):  # of two equally large sets this is their Dice coefficient
            same, told = round(size * common + 0.49), []
            for _ in range(20):
                a = rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2)
                b = np.append(a[:same], rng.integers(0, 2**63, size - same).astype(np.uint64) * np.uint64(2))
                marks = [np.frombuffer(nearpairs.marks_of(x), np.uint64)[None] for x in (a, b)]
                told.append(nearpairs.may_be_similar(*marks, 0.8)[0])
            assert all(told) if kept and common >= 0.8 else size < 1000 or not any(told)
