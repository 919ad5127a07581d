"""Products of columns, summed in one pass: correlations, chained regressions and kernel scores come from them.

Each task sums its rows' products as one matrix; the matrix is cut into pieces of bounded size which are summed by piece, in two steps when tasks are many. The
driver gets the finished matrix only, whose size is that of the columns squared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 16
GROUPS = 64
#: Numbers that the driver holds for all patterns of nulls; beyond it chained imputation scans once per fit.
PATTERN_NUMBERS = 1 << 22


def _merge(table: pa.Table) -> pa.Table:
    total = 0.0
    for raw in table.column("sums"):
        total = total + np.frombuffer(raw.as_buffer())
    return pa.table({"name": table.column("name").slice(0, 1), "piece": table.column("piece").slice(0, 1), "task": table.column("task").slice(0, 1),
                     "sums": pa.array([total.tobytes()], pa.binary())})


def summed(rows: DataFrame, add) -> dict[int, np.ndarray]:
    """Sum over all rows of what ``add(totals, batch)`` adds to the arrays by name in ``totals``; names are whole numbers."""
    schema = "name bigint, piece bigint, task bigint, sums binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                add(totals, batch)
        task = TaskContext.get().partitionId() % GROUPS
        for name, total in totals.items():
            flat = np.ascontiguousarray(total, float).ravel()
            for i in range(0, len(flat), PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (name, i // PIECE, task)] +
                                                 [pa.array([flat[i:i + PIECE].tobytes()], pa.binary())], ["name", "piece", "task", "sums"])
    found = rows.mapInArrow(run, schema)
    if rows.rdd.getNumPartitions() > GROUPS:
        found = found.groupBy("name", "piece", "task").applyInArrow(_merge, schema)
    pieces: dict[int, list] = {}
    for r in found.groupBy("name", "piece").applyInArrow(_merge, schema).collect():
        pieces.setdefault(r["name"], []).append((r["piece"], r["sums"]))
    return {name: np.concatenate([np.frombuffer(s) for _, s in sorted(parts)]) for name, parts in pieces.items()}


def _matrix(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values with 0 for nulls, and 1 where there is one."""
    columns = [batch.column(f"x{j}") for j in range(n)]
    x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns], 1) if n else np.zeros((batch.num_rows, 0))
    known = np.stack([np.asarray(c.is_valid()) for c in columns], 1).astype(float) if n else x
    return x, known


def numbers(df: DataFrame, columns: Sequence[str], *more: Column) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{j}") for j, c in enumerate(columns)], *more)


def correlations(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Pearson correlations of all pairs of a left and a right column, over the rows where both are known; NaN where undefined."""
    names = list(dict.fromkeys([*left, *right]))
    n, at = len(names), {c: j for j, c in enumerate(names)}
    a, b = [at[c] for c in left], [at[c] for c in right]
    rows = numbers(df, names)
    first = rows.agg(*[F.coalesce(F.avg(f"x{j}"), F.lit(0.0)) for j in range(n)]).first()
    center = np.array(list(first), float)

    def add(totals: dict, batch: pa.RecordBatch) -> None:
        x, known = _matrix(batch, n)
        x = (x - center) * known
        xa, xb, ka, kb = x[:, a], x[:, b], known[:, a], known[:, b]
        sums = np.stack([ka.T @ kb, xa.T @ kb, ka.T @ xb, (xa * xa).T @ kb, ka.T @ (xb * xb), xa.T @ xb])
        totals[0] = totals.get(0, 0.0) + sums
    found = summed(rows, add)
    if not found:
        return np.full((len(left), len(right)), np.nan)
    count, sa, sb, qa, qb, ab = found[0].reshape(6, len(left), len(right))
    with np.errstate(divide="ignore", invalid="ignore"):
        va, vb = qa - sa * sa / count, qb - sb * sb / count
        tiny = 1e-12
        good = (count > 1) & (va > tiny * np.maximum(qa, 1e-300)) & (vb > tiny * np.maximum(qb, 1e-300))
        return np.where(good, (ab - sa * sb / count) / np.sqrt(np.where(good, va * vb, 1.0)), np.nan)


def bayesian_ridge(products: np.ndarray, target: int, rounds: int = 300, tolerance: float = 1e-3) -> np.ndarray:
    """Weights of all columns (0 for the target) and an intercept, from summed products of the columns and a last column of ones.

    The precisions of noise and weights are set by evidence updates, with the usual flat priors, until the weights move by less than ``tolerance``.
    """
    d = len(products) - 1
    others = [j for j in range(d) if j != target]
    n, out = products[-1, -1], np.zeros(d + 1)
    if n < 1:
        return out
    mean = products[-1, :d] / n
    centred = products[:d, :d] - n * np.outer(mean, mean)
    xx, xy, yy = centred[np.ix_(others, others)], centred[others, target], max(centred[target, target], 0.0)
    values, vectors = np.linalg.eigh(xx) if others else (np.zeros(0), np.zeros((0, 0)))
    values, rotated = np.maximum(values, 0.0), vectors.T @ xy
    alpha, weight, prior = 1.0 / (yy / n + np.finfo(float).eps), 1.0, 1e-6
    before = None
    for _ in range(rounds):
        part = rotated / (values + weight / alpha)
        coefficients = vectors @ part
        left = max(yy - 2 * coefficients @ xy + coefficients @ xx @ coefficients, 0.0)
        used = float((alpha * values / (weight + alpha * values)).sum())
        weight = (used + 2 * prior) / (float(coefficients @ coefficients) + 2 * prior)
        alpha = (n - used + 2 * prior) / (left + 2 * prior)
        if before is not None and np.abs(coefficients - before).sum() < tolerance:
            break
        before = coefficients
    out[others] = vectors @ (rotated / (values + weight / alpha))
    out[-1] = mean[target] - out[others] @ mean[others]
    return out


class Chain:
    """Chained regressions: which column was refitted with what weights, in order; replaying them fills a row."""

    def __init__(self, means: np.ndarray):
        self.means, self.steps = means, []

    def fill(self, x: np.ndarray, known: np.ndarray) -> np.ndarray:
        out = np.where(known > 0, x, self.means)
        for target, weights in self.steps:
            gaps = known[:, target] == 0
            out[gaps, target] = out[gaps] @ weights[:-1] + weights[-1]
        return out


def fit_chain(df: DataFrame, columns: Sequence[str], rounds: int, tolerance: float, train: Column | None) -> tuple[Chain, list[int], dict[int, np.ndarray]]:
    """Fit the chain; also gives the refitted columns, and by pattern of nulls what maps known values to filled ones (empty if patterns are too many).

    Rows with the same nulls are filled by the same affine map of what they hold, so sums of products by pattern, from one
    scan, serve every fit of every round. With too many patterns each fit takes a scan that replays the chain.
    """
    d = len(columns)
    use = F.lit(1.0) if train is None else F.coalesce(train, F.lit(False)).cast("double")
    bits = [F.when(F.col(f"`{c}`").isNull(), F.lit(1 << j)).otherwise(F.lit(0)).cast("bigint") for j, c in enumerate(columns[:62])]
    pattern = bits[0]
    for b in bits[1:]:
        pattern = pattern + b
    rows = numbers(df, columns, use.alias("use"), pattern.alias("pattern")).persist()
    try:
        told = rows.agg(F.approx_count_distinct("pattern"), F.sum("use"), *[F.avg(F.when(F.col("use") > 0, F.col(f"x{j}"))) for j in range(d)],
                        *[F.sum(F.when(F.col("use") > 0, F.col(f"x{j}").isNull().cast("int"))) for j in range(d)],
                        *[F.max(F.col(f"x{j}").isNull()) for j in range(d)]).first()
        means = np.array([m if m is not None else 0.0 for m in told[2:2 + d]], float)
        missing, open_ = told[2 + d:2 + 2 * d], told[2 + 2 * d:]
        order = [j for j in sorted(range(d), key=lambda j: (missing[j] or 0, j)) if open_[j] and told[2 + j] is not None]
        by_pattern = d <= 62 and 1.1 * (told[0] or 1) * (d + 1) ** 2 <= PATTERN_NUMBERS
        chain, maps, products = Chain(means), {}, {}

        def add_patterns(totals: dict, batch: pa.RecordBatch) -> None:
            x, _ = _matrix(batch, d)
            names, at = np.unique(batch.column("pattern").to_numpy(), return_inverse=True)
            rows_in = np.append(x, np.ones((len(x), 1)), axis=1)
            weight = batch.column("use").to_numpy()
            for i, name in enumerate(names.tolist()):
                some = rows_in[at == i]
                totals[name] = totals.get(name, 0.0) + (some * weight[at == i][:, None]).T @ some

        def scanned(target: int) -> np.ndarray:
            def add(totals: dict, batch: pa.RecordBatch) -> None:
                x, known = _matrix(batch, d)
                filled = np.append(chain.fill(x, known), np.ones((len(x), 1)), axis=1)
                weight = batch.column("use").to_numpy() * known[:, target]
                totals[0] = totals.get(0, 0.0) + (filled * weight[:, None]).T @ filled
            return summed(rows, add)[0].reshape(d + 1, d + 1)
        if by_pattern:
            products = {name: p.reshape(d + 1, d + 1) for name, p in summed(rows, add_patterns).items()}
            for name in products:
                maps[name] = np.eye(d + 1)
                for j in range(d):
                    if name >> j & 1:
                        maps[name][j, j], maps[name][j, -1] = 0.0, means[j]
        spread = None
        for _ in range(rounds):
            moved, total = np.zeros(d), 0.0
            for target in order:
                if by_pattern:
                    known = [name for name in products if not name >> target & 1]
                    sums = sum((maps[n] @ products[n] @ maps[n].T for n in known), np.zeros((d + 1, d + 1)))
                else:
                    sums = scanned(target)
                weights = bayesian_ridge(sums, target)
                n = max(sums[-1, -1], 1.0)
                own = max(sums[target, target] / n - (sums[target, -1] / n) ** 2, 0.0)
                if by_pattern:
                    for name, m in maps.items():
                        if name >> target & 1:
                            new = weights @ m
                            moved[target] += (new - m[target]) @ products[name] @ (new - m[target])
                            m[target] = new
                    total += moved[target] / max(own * max(float(missing[target] or 0), 1.0), 1e-300)
                else:
                    before = next((w for t, w in reversed(chain.steps) if t == target), np.append(np.zeros(d), means[target]))
                    total += float((weights - before) @ sums @ (weights - before)) / max(own * n, 1e-300)
                chain.steps.append((target, weights))
            spread = total / max(len(order), 1)
            if spread < tolerance ** 2:
                break
        return chain, order, maps
    finally:
        rows.unpersist()


def fourier_scores(df: DataFrame, columns: Sequence[str], label: str, train: Column, ridge: float = 1.0, gamma: float | None = None,
                   features: int = 256, seed: int = 42) -> tuple[float, float]:
    """Mean score of the train rows and of the others under a ridge regression on random Fourier features.

    The kernel is ``exp(-gamma |x - y|^2)`` over columns standardised by the train rows (``gamma`` is one over their number if not given); as the features
    grow in number the scores tend to those of the exact kernel ridge with that penalty, with an error that falls as one over the root of
    ``features``. Rows with a null in a column or in the label are left out.
    """
    d = len(columns)
    rows = numbers(df, columns, F.col(label).cast("double").alias("y"), F.coalesce(train, F.lit(False)).cast("double").alias("use"))
    rows = rows.dropna(subset=[*(f"x{j}" for j in range(d)), "y"]).persist()
    try:
        known = F.col("use") > 0
        told = rows.agg(*[x for j in range(d) for x in (F.avg(F.when(known, F.col(f"x{j}"))), F.stddev_pop(F.when(known, F.col(f"x{j}"))))]).first()
        center, scale = (np.array([v or fallback for v in told[i::2]], float) for i, fallback in ((0, 0.0), (1, 1.0)))
        rng = np.random.default_rng(seed)
        waves = rng.normal(scale=np.sqrt(2 * (gamma or 1.0 / d)), size=(d, features // 2))

        def add(totals: dict, batch: pa.RecordBatch) -> None:
            x, _ = _matrix(batch, d)
            turned = (x - center) / scale @ waves
            z = np.concatenate([np.cos(turned), np.sin(turned)], 1) / np.sqrt(features // 2)
            y, use = batch.column("y").to_numpy(), batch.column("use").to_numpy()
            mine = z * use[:, None]
            for name, part in ((0, mine.T @ z), (1, mine.T @ y), (2, mine.sum(0)), (3, z.sum(0)), (4, np.array([use.sum(), len(use)]))):
                totals[name] = totals.get(name, 0.0) + part
        found = summed(rows, add)
        if not found:
            return float("nan"), float("nan")
        size = 2 * (features // 2)
        weights = np.linalg.solve(found[0].reshape(size, size) + ridge * np.eye(size), found[1])
        n, every = found[4]
        return (float(found[2] @ weights / n) if n else float("nan"),
                float((found[3] - found[2]) @ weights / (every - n)) if every > n else float("nan"))
    finally:
        rows.unpersist()
