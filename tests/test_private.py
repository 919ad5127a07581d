"""The private forest: data-independent trees, the noise's scale, and the ledger."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepaudit.operators import private

BOUNDS = {"x": (0.0, 100.0), "z": (0.0, 1.0)}


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    data = [(i, rnd.uniform(-5, 105), rnd.random() if i % 10 else None) for i in range(3000)]
    return spark.createDataFrame([(i, x, z, int(x > 50)) for i, x, z in data], "id long, x double, z double, y int").repartition(5)


def test_trees_keep_to_what_is_left_of_the_bounds():
    column, threshold = private.random_trees(list(BOUNDS.values()), 20, 6, 1)
    for t in range(20):
        for v in range(63):
            low, high = list(map(list, zip(*BOUNDS.values())))
            path, node = [], v
            while node:
                path.append((node, (node - 1) // 2))
                node = (node - 1) // 2
            for side, parent in reversed(path):
                c = column[t, parent]
                (high if side % 2 else low)[c] = threshold[t, parent]
            assert low[column[t, v]] <= threshold[t, v] <= high[column[t, v]]
    assert (private.random_trees(list(BOUNDS.values()), 20, 6, 1)[1] == threshold).all()


@pytest.mark.parametrize("disjoint", [True, False])
def test_counts_votes_and_predictions_by_hand(rows, disjoint, monkeypatch):
    """With a budget so large that noise cannot matter, every vote is the leaf's majority."""
    model = private.fit(rows, BOUNDS, "y", "id", epsilon=1e6, trees=5, depth=4, disjoint=disjoint, seed=1)
    kept = rows.withColumn("key", F.xxhash64("id")).collect()
    counts = np.zeros((5, 16, 2), int)

    def leaf(t, r):
        node = 0
        for _ in range(4):
            value = (r["x"], r["z"])[model.column[t, node]]
            low, high = list(BOUNDS.values())[model.column[t, node]]
            right = value is not None and min(max(value, low), high) > model.threshold[t, node]
            node = 2 * node + 1 + right
        return node - 15
    own = private.mixed(np.array([r["key"] for r in kept]), np.uint64(42)) % np.uint64(5)
    for r, o in zip(kept, own):
        for t in [int(o)] if disjoint else range(5):
            counts[t, leaf(t, r), r["y"]] += 1
    clear = counts[..., 0] != counts[..., 1]
    assert (model.votes[clear] == counts.argmax(-1)[clear]).all() and clear.sum() > 30
    for r in model.transform(rows).collect()[:300]:
        votes = np.bincount([model.votes[t, leaf(t, r)] for t in range(5)], minlength=2)
        assert r["prediction"] == votes.argmax()


def test_scale_of_the_noise(spark):
    """Of many leaves with equal counts, the share of votes for a class is what the exponential mechanism says."""
    leaves, epsilon = 20_000, 0.8
    counts = spark.range(leaves).select(F.lit(0).alias("tree"), F.col("id").cast("int").alias("leaf"), F.inline(F.array(
        F.struct(F.lit(0).alias("label"), F.lit(5).alias("n")), F.struct(F.lit(2).alias("label"), F.lit(3).alias("n")))))
    weights = [math.exp(epsilon * n / 2) for n in (5, 0, 3)]
    for seed in (7, None):
        found = private.noisy_votes(counts, 1, leaves, 3, epsilon, seed).groupBy("vote").count().collect()
        shares = {r["vote"]: r["count"] / leaves for r in found}
        for c, w in enumerate(weights):
            assert shares[c] == pytest.approx(w / sum(weights), abs=0.015)


def test_empty_leaves_vote_as_well(rows):
    model = private.fit(rows.limit(0), BOUNDS, "y", "id", trees=4, depth=8, seed=3)
    assert 0.4 < model.votes.mean() < 0.6
    assert model.transform(rows.limit(0)).count() == 0


def test_ledger_adds_up_to_epsilon(rows):
    for disjoint, entries in ((True, 1.5), (False, 0.15)):
        model = private.fit(rows, BOUNDS, "y", "id", epsilon=1.5, trees=10, depth=3, disjoint=disjoint, seed=3)
        assert [e.epsilon for e in model.ledger.entries] == pytest.approx([entries] * 10)
        assert model.ledger.total() == pytest.approx(1.5)
        with pytest.raises(ValueError, match="spend more"):
            model.ledger.spend("counts", 0.1)
    ledger = private.Ledger(1.0)
    ledger.spend("all", 0.25)
    ledger.spend("a", 0.5, 0)
    ledger.spend("b", 0.75, 1)
    assert ledger.total() == 1.0 and len(ledger.entries) == 3


def test_learns_what_the_budget_allows(rows):
    right = {e: private.fit(rows, BOUNDS, "y", "id", epsilon=e, trees=10, depth=5, seed=5).transform(rows).filter("prediction = y").count() / 3000
             for e in (0.001, 5.0)}
    assert right[5.0] > 0.85 > right[0.001]


def test_rows_without_key_or_label_are_left_out(spark):
    rows = [(None, 1.0, 0.5, 1), (1, 2.0, 0.5, None), (2, 3.0, None, 7), (3, None, None, 1)]
    df = spark.createDataFrame(rows, "id long, x double, z double, y int")
    model = private.fit(df, BOUNDS, "y", "id", trees=1, depth=1, epsilon=1e6, seed=1)
    assert model.votes[0, 0] == 1
    with pytest.raises(ValueError, match="leaves"):
        private.fit(df, BOUNDS, "y", "id", trees=100, depth=20)
