"""A forest under differential privacy: random trees that no data decides, and leaves that vote through the exponential mechanism.

Cuts come from a seed and from bounds that the caller states, never from rows. Rows only decide the leaves' votes. A leaf votes for class c with
probability proportional to ``exp(epsilon * n_c / 2)``, n_c being its rows of that class, of which one row changes one by 1; leaves
of one tree hold different rows, so a tree spends its epsilon once. Every leaf votes, empty ones too, as a missing vote would tell. If each row serves one tree,
trees spend side by side; if every tree sees all rows, their budgets add up. A ledger writes down which it was.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepaudit.functions.hashing import fine_uniform
from prepaudit.operators.distributed import settle
from prepaudit.operators.forest import mixed

#: Votes of a model are sent to every task: trees times leaves stay below this.
MOST_LEAVES = 1 << 22


class Spent(NamedTuple):
    """One use of the data: what spent how much, and which share of the rows it saw (None: all)."""

    what: str
    epsilon: float
    part: int | None


class Ledger:
    """Budget spent: uses of one part add up, different parts run side by side, uses of all rows add to every part."""

    def __init__(self, epsilon: float):
        self.epsilon, self.entries = epsilon, []

    def total(self) -> float:
        by_part: dict = {}
        whole = math.fsum(e.epsilon for e in self.entries if e.part is None)
        for e in self.entries:
            if e.part is not None:
                by_part.setdefault(e.part, []).append(e.epsilon)
        return whole + max((math.fsum(v) for v in by_part.values()), default=0.0)

    def spend(self, what: str, epsilon: float, part: int | None = None) -> None:
        self.entries.append(Spent(what, epsilon, part))
        if self.total() > self.epsilon * (1 + 1e-9):
            self.entries.pop()
            raise ValueError(f"{what} would spend more than {self.epsilon}")


def random_trees(bounds: Sequence[tuple[float, float]], trees: int, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Column and threshold of every inner node, ``[tree, node]`` in heap order; a threshold is uniform in what is left of the column's bounds."""
    inner = (1 << depth) - 1
    column, threshold = np.zeros((trees, inner), np.int16), np.zeros((trees, inner))
    low = np.tile(np.array([b[0] for b in bounds], float), (trees, inner + 1, 1))
    high = np.tile(np.array([b[1] for b in bounds], float), (trees, inner + 1, 1))
    tree = np.arange(trees)
    for v in range(inner):
        h = mixed(tree, np.uint64(v), np.uint64(seed))
        column[:, v] = h % np.uint64(len(bounds))
        u = (mixed(h, np.uint64(1)) >> np.uint64(11)).astype(float) / 2.0 ** 53
        c = column[:, v].astype(np.int64)
        threshold[:, v] = low[tree, v, c] + u * (high[tree, v, c] - low[tree, v, c])
        for side, edge in ((2 * v + 1, high), (2 * v + 2, low)):
            if side < inner:
                low[:, side], high[:, side] = low[:, v], high[:, v]
                edge[tree, side, c] = threshold[:, v]
    return column, threshold


def leaf_of(x: np.ndarray, column: np.ndarray, threshold: np.ndarray, tree: np.ndarray, depth: int) -> np.ndarray:
    """Leaf of every row in its tree; a null goes left."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        node = 2 * node + 1 + (x[rows, column[tree, node]] > threshold[tree, node])
    return node - ((1 << depth) - 1)


def _matrix(batch: pa.RecordBatch, columns: Sequence[str], bounds) -> np.ndarray:
    parts = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
    return np.stack([np.clip(p, *b) for p, b in zip(parts, bounds)], 1)


class PrivateForest:
    """Trees, and the class that every leaf votes for."""

    def __init__(self, columns, bounds, depth, column, threshold, votes, classes, ledger: Ledger):
        self.columns, self.bounds, self.depth, self.column, self.threshold = list(columns), list(bounds), depth, column, threshold
        self.votes, self.classes, self.ledger = votes, classes, ledger

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """Add the class with most votes, the least of equal ones. What reads only votes spends nothing more."""
        bounds, depth, column, threshold, votes, classes = self.bounds, self.depth, self.column, self.threshold, self.votes, self.classes
        names = [f"f{j}" for j in range(len(self.columns))]
        rows = settle(df.withColumn("__row", F.monotonically_increasing_id()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch, names, bounds)
                total = np.zeros((len(x), classes), np.int64)
                for t in range(len(column)):
                    leaf = leaf_of(x, column, threshold, np.full(len(x), t), depth)
                    total[np.arange(len(x)), votes[t, leaf]] += 1
                yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(total.argmax(1).astype(float))], ["__of", prediction])
        given = rows.select("__row", *[F.col(c).cast("double").alias(n) for n, c in zip(names, self.columns)])
        found = given.mapInArrow(run, f"__of bigint, {prediction} double")
        return rows.join(found, rows["__row"] == found["__of"]).drop("__row", "__of")


def noisy_votes(counts: DataFrame, trees: int, leaves: int, classes: int, epsilon: float, seed: int | None) -> DataFrame:
    """``(tree, leaf, vote)`` for every leaf, from ``(tree, leaf, label, n)``.

    The greatest of ``epsilon * n / 2`` plus standard Gumbel noise is a draw from the exponential mechanism.
    """
    spark = counts.sparkSession
    cells = spark.range(trees * leaves * classes).select(
        F.expr(f"cast(id div {leaves * classes} as int)").alias("tree"), F.expr(f"cast(id div {classes} % {leaves} as int)").alias("leaf"),
        (F.col("id") % classes).cast("int").alias("label"))
    joined = cells.join(counts, ["tree", "leaf", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    u = F.rand(secrets.randbits(62)) if seed is None else fine_uniform(seed, "tree", "leaf", "label")
    gumbel = -F.log(-F.log(F.greatest(u, F.lit(1e-300))))
    scored = joined.withColumn("score", F.lit(epsilon / 2) * F.col("n") + gumbel)
    return scored.groupBy("tree", "leaf").agg(F.max_by("label", F.struct("score", "label")).alias("vote"))


def fit(df: DataFrame, bounds: Mapping[str, tuple[float, float]], label: str, key: str, classes: int = 2, epsilon: float = 1.0, trees: int = 10,
        depth: int = 8, disjoint: bool = True, seed: int | None = None, shape_seed: int = 42) -> PrivateForest:
    """Fit a private forest; ``bounds`` names the columns and their ranges, which must not come from the data.

    With ``disjoint`` each row serves the tree that a hash of its key names, and every tree may spend all of ``epsilon``; else each tree sees all rows and
    spends its share. A value beyond its bounds counts as the bound, a null as below every threshold. Rows with a null key or a label outside
    0 to ``classes`` - 1 are left out. ``key`` must name what is to be protected, once per row. Leave ``seed`` unset outside of tests: noise that can be repeated protects nobody.
    """
    columns, limits, leaves = list(bounds), list(bounds.values()), 1 << depth
    if trees * leaves > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    ledger, each = Ledger(epsilon), epsilon if disjoint else epsilon / trees
    for t in range(trees):
        ledger.spend(f"tree {t}", each, t if disjoint else None)
    column, threshold = random_trees(limits, trees, depth, shape_seed)
    names = [f"f{j}" for j in range(len(columns))]
    given = df.filter(F.col(key).isNotNull() & F.col(label).between(0, classes - 1)).select(
        F.xxhash64(key).alias("key"), F.col(label).cast("int").alias("label"), *[F.col(c).cast("double").alias(n) for n, c in zip(names, columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(trees * leaves * classes, np.int64)
        for batch in batches:
            x, y = _matrix(batch, names, limits), batch.column("label").to_numpy().astype(np.int64)
            own = (mixed(batch.column("key").to_numpy(), np.uint64(shape_seed)) % np.uint64(trees)).astype(np.int64)
            for tree in [own] if disjoint else [np.full(len(x), t) for t in range(trees)]:
                at = (tree * leaves + leaf_of(x, column, threshold, tree, depth)) * classes + y
                total += np.bincount(at, minlength=len(total))
        some = np.flatnonzero(total)
        tree, leaf, y = some // (leaves * classes), some // classes % leaves, some % classes
        yield pa.RecordBatch.from_arrays([*(pa.array(a.astype(np.int32)) for a in (tree, leaf, y)), pa.array(total[some])], ["tree", "leaf", "label", "n"])
    counts = given.mapInArrow(run, "tree int, leaf int, label int, n bigint").groupBy("tree", "leaf", "label").agg(F.sum("n").alias("n"))
    found = noisy_votes(counts, trees, leaves, classes, each, seed).toArrow()  # one row per leaf, of which there are MOST_LEAVES at most
    votes = np.zeros((trees, leaves), np.int64)
    votes[found.column("tree").to_numpy(), found.column("leaf").to_numpy()] = found.column("vote").to_numpy()
    return PrivateForest(columns, limits, depth, column, threshold, votes, classes, ledger)
