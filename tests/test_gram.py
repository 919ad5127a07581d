"""Sums of products against dense arithmetic."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepaudit.operators import gram, impute, metrics, relevance


def with_gaps(spark, n=400, share=0.2, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(50, 10, n), rng.normal(size=n)
    x = np.stack([a, b, 2 * a - 30 * b + rng.normal(size=n), a * 0.5 + rng.normal(size=n), rng.normal(size=n)], 1)
    x[:, :4][rng.random((n, 4)) < np.array([0.05, 0.0, share, share / 2])] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, d double, e double").repartition(5), x


COLUMNS = ["a", "b", "c", "d", "e"]


def plain_ridge(x, y):
    """Bayesian ridge by evidence updates on the rows themselves."""
    xm, ym, n = x.mean(0), y.mean(), len(y)
    xc, yc = x - xm, y - ym
    alpha, lam, before = 1 / (y.var() + np.finfo(float).eps), 1.0, None
    for _ in range(300):
        coef = np.linalg.solve(xc.T @ xc + lam / alpha * np.eye(x.shape[1]), xc.T @ yc)
        eig = np.linalg.eigvalsh(xc.T @ xc)
        gamma = (alpha * eig / (lam + alpha * eig)).sum()
        lam = (gamma + 2e-6) / (coef @ coef + 2e-6)
        alpha = (n - gamma + 2e-6) / (((yc - xc @ coef) ** 2).sum() + 2e-6)
        if before is not None and np.abs(coef - before).sum() < 1e-3:
            break
        before = coef
    coef = np.linalg.solve(xc.T @ xc + lam / alpha * np.eye(x.shape[1]), xc.T @ yc)
    return coef, ym - coef @ xm


def plain_chain(x, use, rounds):
    gaps = np.isnan(x)
    filled = np.where(gaps, np.nanmean(x[use], axis=0), x)
    order = [j for j in np.argsort(gaps[use].sum(0), kind="stable") if gaps[:, j].any()]
    for _ in range(rounds):
        for t in order:
            others = [j for j in range(x.shape[1]) if j != t]
            known = use & ~gaps[:, t]
            coef, intercept = plain_ridge(filled[known][:, others], filled[known, t])
            filled[gaps[:, t], t] = filled[gaps[:, t]][:, others] @ coef + intercept
    return filled


@pytest.mark.parametrize("limit", [gram.PATTERN_NUMBERS, 0])
@pytest.mark.parametrize("rounds", [1, 3])
def test_chained_imputation_equals_the_dense_one(spark, monkeypatch, limit, rounds):
    monkeypatch.setattr(gram, "PATTERN_NUMBERS", limit)
    df, x = with_gaps(spark)
    train = F.col("id") % 4 != 0
    found = np.array([r[1:] for r in impute.impute_regression(df, COLUMNS, rounds=rounds, train=train, tolerance=0).orderBy("id").collect()])
    assert np.abs(found - plain_chain(x, np.arange(len(x)) % 4 != 0, rounds)).max() < 1e-6


def test_imputation_settles_and_keeps_what_is_known(spark):
    df, x = with_gaps(spark, share=0.3)
    chain, order, maps = gram.fit_chain(df, COLUMNS, 50, 1e-3, None)
    assert order == [0, 3, 2] and len(chain.steps) < 150 and len(maps) > 5
    found = impute.impute_regression(df, COLUMNS).orderBy("id").collect()
    assert all(r[j + 1] == pytest.approx(x[i, j]) for i, r in enumerate(found) for j in range(5) if not np.isnan(x[i, j]))
    empty = df.withColumn("e", F.lit(None).cast("double"))
    assert impute.impute_regression(empty, COLUMNS).filter("e IS NOT NULL OR c IS NULL").count() == 0
    assert impute.impute_regression(df.limit(0), COLUMNS).count() == 0


def test_correlations_of_columns_with_nulls(spark):
    df, x = with_gaps(spark)
    df = df.withColumns({"same": F.lit(3.0), "none": F.lit(None).cast("double")})
    found = gram.correlations(df, [*COLUMNS, "same", "none"], COLUMNS)
    for i in range(5):
        for j in range(5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert found[i, j] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1])
    assert np.isnan(found[5:]).all()


def test_a_thousand_dummies_in_one_pass(spark):
    rng = np.random.default_rng(5)
    rows = [(int(v),) for v in rng.integers(0, 1000, 4000)]
    wide = spark.createDataFrame(rows, "v int").select(*[(F.col("v") == i).cast("int").alias(f"d{i}") for i in range(1000)])
    found = gram.correlations(wide, [f"d{i}" for i in range(1000)], [f"d{i}" for i in range(1000)])
    dense = np.eye(1000)[[r[0] for r in rows]]
    with np.errstate(invalid="ignore", divide="ignore"):
        expected = np.corrcoef(dense.T)
    both = ~np.isnan(expected)
    assert np.abs(found[both] - expected[both]).max() < 1e-9 and np.isnan(found[~both]).all()


def test_matrix_and_proxies(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(-i % 3), 1.0) for i in range(30)], "p double, q double, r double, s double")
    rows = {(r["a"], r["b"]): r["corr"] for r in relevance.correlation_matrix(df, ["p", "q", "r", "s"]).collect()}
    assert list(rows) == [("p", "q"), ("p", "r"), ("p", "s"), ("q", "r"), ("q", "s"), ("r", "s")]
    assert rows["p", "q"] == pytest.approx(1) and rows["p", "s"] is None
    flagged = {r["feature"]: r["proxy"] for r in relevance.proxies(df, ["p"], ["q", "r", "s"]).collect()}
    assert flagged == {"q": True, "r": False, "s": False}


def test_kernel_shift_check_against_the_dense_kernel(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2))
    x[400:] += 1.2  # the test rows have moved
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] + rng.normal(scale=0.1, size=500)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id int, a double, b double, y double")
    scaled = (x - x[:400].mean(0)) / x[:400].std(0)
    kernel = np.exp(-0.5 * ((scaled[:, None] - scaled[None, :400]) ** 2).sum(-1))
    scores = kernel @ np.linalg.solve(kernel[:400] + np.eye(400), y[:400])
    train = F.col("id") < 400
    row = metrics.shift_check_kernel(df, ["a", "b"], "y", train, features=1024).first()
    assert row["train_mean"] == pytest.approx(scores[:400].mean(), abs=0.02) and row["test_mean"] == pytest.approx(scores[400:].mean(), abs=0.05)
    assert row["shifted"] and row["gap"] == pytest.approx(abs(row["train_mean"] - row["test_mean"]))
    still = metrics.shift_check_kernel(df.filter(train), ["a", "b"], "y", F.col("id") % 2 == 0, threshold=0.3).first()
    assert not still["shifted"] and still["gap"] < row["gap"]


def test_sums_in_two_steps_and_pieces(spark, monkeypatch):
    df, _ = with_gaps(spark)
    whole = gram.correlations(df, COLUMNS, COLUMNS)
    monkeypatch.setattr(gram, "GROUPS", 2)
    assert np.nanmax(np.abs(gram.correlations(df, COLUMNS, COLUMNS) - whole)) < 1e-12
