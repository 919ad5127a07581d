"""Many logistic regressions at once: each pass over the rows serves every model.

A row belongs to a cell, such as (fold, label) or (group, label), and a model says with what weight and as which class it sees each cell. Folds,
points of a grid and the reweighed problems of constrained training differ in nothing else, so one pass sums the gradient and
the curvature of all of them, and Newton steps (with coordinate descent for a penalty on absolute weights) follow on the driver, where
sizes depend on models and columns only. What a model fits to its own rows, means, deviations and fills, is an affine map of shared columns,
found from one pass of moments by cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepaudit.operators.distributed import quantiles

#: Sums of one pass: beyond this many numbers models are taken some at a time, so that no message grows with their number.
PASS_NUMBERS = 1 << 22
GROUPS = 64
TOLERANCE = 1e-10


class Problem(NamedTuple):
    """One model: weight and class of each cell, penalty, and the share of it on absolute weights."""

    weight: np.ndarray
    target: np.ndarray
    reg: float = 0.0
    l1: float = 0.0


class Solution(NamedTuple):
    """Weights of the shared columns with the intercept last, and how many rows of each cell are predicted 1."""

    weights: np.ndarray
    positives: np.ndarray
    loss: float


class Reader(NamedTuple):
    """What a task needs to read a batch of a design's rows."""

    columns: tuple[str, ...]
    center: np.ndarray
    scale: np.ndarray
    numeric: int
    filled: bool

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and the shared columns centred and scaled with a last column of ones; a null is 0 here and 1 in its indicator."""
        x = np.ones((batch.num_rows, len(self.columns) + 1))
        for j, c in enumerate(self.columns):
            x[:, j] = batch.column(c).fill_null(0.0).to_numpy(zero_copy_only=False)
        x[:, :-1] -= self.center
        x[:, :-1] /= self.scale
        if self.filled:
            x[:, :self.numeric] *= 1.0 - x[:, self.numeric:2 * self.numeric]
        return batch.column("cell").to_numpy(zero_copy_only=False), x


def _tree_sum(df: DataFrame, width: int) -> np.ndarray:
    """Sum the arrays that tasks emit, in two steps when there are many tasks: one row per group reaches the driver."""
    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for raw in table.column("sums"):
            total += np.frombuffer(raw.as_buffer())
        return pa.table({"task": table.column("task").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})
    if df.rdd.getNumPartitions() > GROUPS:
        df = df.groupBy("task").applyInArrow(merge, "task bigint, sums binary")
    total = np.zeros(width)
    for row in df.select("sums").collect():
        total += np.frombuffer(row["sums"])
    return total


def _summed(rows: DataFrame, width: int, add) -> np.ndarray:
    """``add(total, batch)`` over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            add(total, batch)
        task = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["task", "sums"])
    return _tree_sum(rows.mapInArrow(run, "task bigint, sums binary"), width)


class Design:
    """Numeric columns, indicators of their nulls, and the values of categorical columns, ready for passes.

    ``rows`` holds ``cell`` and one double per shared column. ``center`` and ``scale`` keep numbers of very different size apart
    from the arithmetic; weights are given for the columns as they are.
    """

    def __init__(self, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], cell: Column, cells: int,
                 filled: bool = False, values: Mapping[str, Sequence] | None = None):
        self.numeric, self.categorical, self.cells = list(numeric), list(categorical), cells
        self.values = dict(values) if values is not None else _category_values(df, self.categorical)
        shared = {f"x{j}": F.col(c).cast("double") for j, c in enumerate(self.numeric)}
        if filled:
            shared |= {f"n{j}": F.col(c).isNull().cast("double") for j, c in enumerate(self.numeric)}
        shared |= {f"c{j}_{i}": F.col(c).eqNullSafe(F.lit(v)).cast("double")
                   for j, c in enumerate(self.categorical) for i, v in enumerate(self.values[c])}
        self.columns, self.filled, self.expressions = list(shared), filled, shared
        self.rows = df.select(cell.cast("int").alias("cell"), *[e.alias(n) for n, e in shared.items()])
        self._measure()

    def _measure(self) -> None:
        """One pass of counts, sums and squares of every column by cell, around a first mean."""
        names, d = self.columns, len(self.columns)
        first = self.rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names],
                              *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in names]).first()
        if not self.filled and any(first[f"null_{c}"] for c in names):
            raise ValueError("null in a column: fill first, or name a fill")
        self.center = np.array([first[c] if c.startswith("x") else 0.0 for c in names])
        totals = self.rows.groupBy("cell").agg(
            F.count("*").alias("rows"), *[x for j, c in enumerate(names) for x in (
                F.sum(F.col(c) - self.center[j]).alias(f"s{j}"), F.sum((F.col(c) - self.center[j]) ** 2).alias(f"q{j}"))])
        self.n, self.sums, self.squares = np.zeros(self.cells), np.zeros((self.cells, d)), np.zeros((self.cells, d))
        for r in totals.collect():  # one row per cell
            self.n[r["cell"]] = r["rows"]
            self.sums[r["cell"]] = [r[f"s{j}"] or 0.0 for j in range(d)]
            self.squares[r["cell"]] = [r[f"q{j}"] or 0.0 for j in range(d)]
        spread = np.sqrt(np.maximum(self.squares.sum(0) / max(self.n.sum(), 1), 0))
        self.scale = np.array([s if c.startswith("x") and s > 0 else 1.0 for c, s in zip(names, spread)])

    def standard(self, weight: np.ndarray, fills: Sequence[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The map from (shared columns, 1), centred and scaled, to a model's own standardised columns and 1.

        Means and population deviations are those of the rows that the cell weights keep (each counted once); a column without spread is only centred.
        ``fills`` are the values for nulls of the numeric columns, the mean where absent.
        """
        use = (np.asarray(weight) > 0).astype(float)
        n, sums, squares = use @ self.n, use @ self.sums, use @ self.squares
        names, k = self.columns, len(self.numeric)
        nulls = sums[k:2 * k] if self.filled else np.zeros(k)
        own = [j for j in range(len(names)) if not names[j].startswith("n")]
        out = np.zeros((len(own) + 1, len(names) + 1))
        for row, j in enumerate(own):
            total, square, fill = sums[j], squares[j], 0.0
            if j < k and self.filled:
                some = n - nulls[j]
                fill = (fills[j] - self.center[j]) if fills is not None else (total / some if some else 0.0)
                total, square = total + fill * nulls[j], square + fill * fill * nulls[j]
            mean = total / n if n else 0.0
            spread = math.sqrt(max(square / n - mean * mean, 0.0)) if n else 0.0
            spread = spread if spread > 1e-12 * max(1.0, abs(mean)) else 1.0
            # rows are (x - center) / scale with 0 for a null, and the indicator as it is
            out[row, j] = self.scale[j] / spread
            out[row, -1] = -mean / spread
            if j < k and self.filled:
                out[row, k + j] = fill / spread
        out[-1, -1] = 1.0
        return out, use

    def reader(self) -> "Reader":
        return Reader(tuple(self.columns), self.center, self.scale, len(self.numeric), self.filled)

    def margin(self, weights: np.ndarray) -> Column:
        """The model's margin as a column expression over the given frame, no Python."""
        out = F.lit(float(weights[-1]))
        for j, c in enumerate(self.columns):
            value = (F.coalesce(self.expressions[c], F.lit(float(self.center[j]))) - float(self.center[j])) / float(self.scale[j])
            out = out + F.lit(float(weights[j])) * value
        return out


def _category_values(df: DataFrame, columns: Sequence[str]) -> dict:
    """Distinct values of all columns, from one job; every one of them becomes a column, so they are few."""
    if not columns:
        return {}
    found = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns]).first()
    return {c: list(found[c]) for c in columns}


def _pass(design: Design, problems: Sequence[Problem], weights: np.ndarray, curvature: bool = True):
    """Loss, gradient, curvature and predicted positives by cell of every model at its weights, in one scan."""
    d, m, cells = len(design.columns) + 1, len(problems), design.cells
    cell_weight = np.array([p.weight for p in problems])
    target = np.array([p.target for p in problems], float)
    size = 1 + d + d * d * curvature + cells
    reader = design.reader()

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        cell, x = reader(batch)
        margins = x @ weights.T
        chance = 1.0 / (1.0 + np.exp(-np.clip(margins, -500, 500)))
        per_model = total.reshape(m, size)
        for i in range(m):
            w, t, z, p = cell_weight[i][cell], target[i][cell], margins[:, i], chance[:, i]
            per_model[i, 0] += w @ (np.logaddexp(0, z) - t * z)
            per_model[i, 1:1 + d] += x.T @ (w * (p - t))
            if curvature:
                per_model[i, 1 + d:1 + d + d * d] += (x.T @ (x * (w * p * (1 - p))[:, None])).ravel()
            per_model[i, -cells:] += np.bincount(cell[z > 0], minlength=cells)
    total = _summed(design.rows, m * size, add).reshape(m, size)
    return total[:, 0], total[:, 1:1 + d], total[:, 1 + d:1 + d + d * d].reshape(m, d, d) if curvature else None, total[:, -cells:]


def _quadratic_step(gradient: np.ndarray, curvature: np.ndarray, at: np.ndarray, l1: float) -> np.ndarray:
    """Minimise the quadratic model plus ``l1`` times the absolute weights (the last is free) by coordinate descent."""
    if l1 == 0:
        return np.linalg.solve(curvature, -gradient)
    new, slope = at.copy(), gradient.copy()
    for _ in range(10_000):
        most = 0.0
        for j in range(len(at)):
            c = curvature[j, j]
            if c <= 0:
                continue
            wanted = c * new[j] - slope[j]
            value = wanted / c if j == len(at) - 1 else math.copysign(max(abs(wanted) - l1, 0.0), wanted) / c
            change = value - new[j]
            if change:
                slope += curvature[:, j] * change
                new[j] = value
                most = max(most, abs(change) * math.sqrt(c))
        if most < 1e-13:
            break
    return new - at


def fit_all(design: Design, problems: Sequence[Problem], fills: Sequence[Sequence[float] | None] | None = None, starts: np.ndarray | None = None,
            max_iter: int = 100, tolerance: float = TOLERANCE) -> list[Solution]:
    """Fit every model to ``mean loss + reg * (l1 * |w| + (1 - l1) / 2 * w^2)`` over its weighted rows.

    The penalty is on the weights of the model's own standardised columns, not on the intercept, and the mean is over the summed weights.
    All models take their Newton steps in lockstep; one whose step does not lower its objective halves it in the next scan.
    ``starts`` are weights of an earlier solution (of shared columns). The number of scans is that of the slowest model.
    """
    per_model = (len(design.columns) + 2) ** 2 + design.cells
    at_once = max(1, PASS_NUMBERS // per_model)
    if len(problems) > at_once:
        return [s for i in range(0, len(problems), at_once) for s in fit_all(
            design, problems[i:i + at_once], fills[i:i + at_once] if fills else None,
            starts[i:i + at_once] if starts is not None else None, max_iter, tolerance)]
    maps = [design.standard(p.weight, fills[i] if fills else None)[0] for i, p in enumerate(problems)]
    mass = [max(float(np.asarray(p.weight, float) @ design.n), 1e-300) for p in problems]
    m = len(problems)
    here = [np.zeros(len(t)) for t in maps]
    if starts is not None:
        here = [np.linalg.lstsq(t.T, s, rcond=None)[0] for t, s in zip(maps, starts)]
    tried, steps, value, done = [h.copy() for h in here], [None] * m, [math.inf] * m, [False] * m
    held: list[tuple] = [()] * m
    for _ in range(max_iter):
        open_ = [i for i in range(m) if not done[i]]
        if not open_:
            break
        loss, slope, curve, positives = _pass(design, [problems[i] for i in open_], np.array([tried[i] @ maps[i] for i in open_]))
        for row, i in enumerate(open_):
            p, t, w = problems[i], maps[i], tried[i]
            ridge, lasso = p.reg * (1 - p.l1), p.reg * p.l1
            now = loss[row] / mass[i] + ridge / 2 * (w[:-1] @ w[:-1]) + lasso * np.abs(w[:-1]).sum()
            if now > value[i] + 1e-14 * max(1.0, abs(value[i])):
                steps[i] = steps[i] / 2
                if np.abs(steps[i]).max() < tolerance:
                    done[i] = True
                tried[i] = here[i] + steps[i]
                continue
            here[i], value[i], held[i] = w, now, (positives[row], loss[row] / mass[i])
            gradient, curvature = t @ slope[row] / mass[i], t @ curve[row] @ t.T / mass[i]
            gradient[:-1] += ridge * w[:-1]
            curvature[np.arange(len(w) - 1), np.arange(len(w) - 1)] += ridge
            curvature[np.arange(len(w)), np.arange(len(w))] += 1e-12  # a column without spread
            steps[i] = _quadratic_step(gradient, curvature, w, lasso)
            if np.abs(steps[i]).max() < tolerance * max(1.0, np.abs(w).max()):
                done[i] = True
            tried[i] = w + steps[i]
    return [Solution(h @ t, *told) for h, t, told in zip(here, maps, held)]


def counts_of(design: Design, weights: Sequence[np.ndarray]) -> np.ndarray:
    """Rows predicted 1 by (model, cell), in one scan."""
    blank = Problem(np.zeros(design.cells), np.zeros(design.cells))
    return _pass(design, [blank] * len(weights), np.array(weights), curvature=False)[3]


class FoldedGrid:
    """Every point of a grid on the train rows of every fold, with what each predicts of the held-out rows.

    Cells are (fold, label). Means, deviations, fills and categories are those of each fold's train rows; a category that only held-out
    rows have counts as unknown, with all its columns 0.
    """

    def __init__(self, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, fold: str, folds: int,
                 points: Sequence[Mapping[str, float]], fill: str | None = None):
        self.folds, self.points = folds, list(points)
        kept = df.select(*dict.fromkeys([*numeric, *categorical, label, fold])).persist()
        try:
            cell = F.col(fold).cast("int") * 2 + (F.col(label) == 1).cast("int")
            self.design = Design(kept, numeric, categorical, cell, 2 * folds, filled=fill is not None)
            self.design.rows = self.design.rows.persist()
            fills = None
            if fill == "median":
                fills = self._medians(kept, numeric, fold)
            problems, of = [], []
            for f in range(folds):
                weight = np.array([0.0 if c // 2 == f else 1.0 for c in range(2 * folds)])
                for point in self.points:
                    problems.append(Problem(weight, np.arange(2 * folds) % 2, point.get("regParam", 0.0), point.get("elasticNetParam", 0.0)))
                    of.append(fills[f] if fills else None)
            self.solutions = fit_all(self.design, problems, of if fills else None)
        finally:
            if hasattr(self, "design"):
                self.design.rows.unpersist()
            kept.unpersist()

    def _medians(self, df: DataFrame, numeric: Sequence[str], fold: str) -> list[list[float]]:
        """Exact medians of the train rows of every fold, from one plan."""
        others = F.array(*[F.lit(f) for f in range(self.folds)])
        spread = df.select(*numeric, F.explode(F.array_remove(others, F.col(fold).cast("int"))).alias("__of"))
        found = {(r["__of"], r["feature"]): r["q0"] for r in quantiles(spread, list(numeric), [0.5], by=["__of"]).collect()}
        return [[found.get((f, c)) or 0.0 for c in numeric] for f in range(self.folds)]

    def confusion(self) -> np.ndarray:
        """``[fold, point, label, prediction]`` counts of held-out rows."""
        out = np.zeros((self.folds, len(self.points), 2, 2))
        for i, s in enumerate(self.solutions):
            f, p = divmod(i, len(self.points))
            for y in (0, 1):
                out[f, p, y, 1] = s.positives[2 * f + y]
                out[f, p, y, 0] = self.design.n[2 * f + y] - s.positives[2 * f + y]
        return out


def scores(confusion: np.ndarray, metric: str) -> np.ndarray:
    """Accuracy, or precision, recall and f1 of label 1, from ``[..., label, prediction]`` counts."""
    hit, n = confusion[..., 1, 1], confusion.sum((-1, -2))
    said, real = confusion[..., 1].sum(-1), confusion[..., 1, :].sum(-1)

    def share(a, b):
        return np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    if metric == "accuracy":
        return share(hit + confusion[..., 0, 0], n)
    return {"precision": share(hit, said), "recall": share(hit, real), "f1": share(2 * hit, said + real)}[metric]


def point_name(point: Mapping[str, float]) -> str:
    return ", ".join(f"{k}={v}" for k, v in sorted(point.items()))


def grid_search(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, fold: str, points: Sequence[Mapping[str, float]],
                folds: int = 5, metric: str = "accuracy", fill: str | None = None) -> DataFrame:
    """``(parameters, mean_score, best)`` of logistic regressions; the number of jobs does not depend on folds and points.

    A point names ``regParam`` and ``elasticNetParam``, as per row as Spark's learner takes them. Everything is refitted on each
    fold's train rows: ``fill`` is ``median``, ``mean`` or None (a null is an error then), columns are standardised, categories become one column each.
    """
    found = FoldedGrid(df, numeric, categorical, label, fold, folds, points, fill)
    mean = scores(found.confusion(), metric).mean(0)
    best = int(np.argmax(mean))
    rows = [(point_name(p), float(s), i == best) for i, (p, s) in enumerate(zip(points, mean))]
    return df.sparkSession.createDataFrame(rows, "parameters string, mean_score double, best boolean")


def cross_validate(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, fold: str, point: Mapping[str, float],
                   folds: int = 5, metrics: Sequence[str] = ("accuracy",), fill: str | None = None) -> DataFrame:
    """``(fold, <metric>...)`` with every fold's model fitted in the same scans."""
    confusion = FoldedGrid(df, numeric, categorical, label, fold, folds, [point], fill).confusion()[:, 0]
    found = [scores(confusion, m) for m in metrics]
    rows = [(f, *(float(s[f]) for s in found)) for f in range(folds)]
    return df.sparkSession.createDataFrame(rows, "fold int, " + ", ".join(f"{m} double" for m in metrics))
