"""Training under a bound on demographic parity, by the exponentiated-gradient reduction.

The constraint is that no group's share of positive predictions differs from the overall one by more than ``bound``. Each group and sign has a
multiplier; given the multipliers, the best classifier is that of a cost-sensitive problem in which a row's cost depends on its group and
label only. So each round fits one reweighed model, and the game between multipliers and the models found so far is solved on the
driver, where it has one number per group and model. The answer is a randomised mixture of models.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepaudit.functions.hashing import fine_uniform
from prepaudit.operators.linear import Design, Problem, fit_all

class Round(NamedTuple):
    """Error and greatest violation of the mixture after a round, and the bounds on the game's value."""

    error: float
    violation: float
    lower: float
    upper: float


class Mixture:
    """Models with probabilities: a row is predicted 1 by the share of models that say so."""

    def __init__(self, design: Design, weights: list[np.ndarray], shares: np.ndarray, rounds: list[Round], rates: np.ndarray):
        self.design, self.rounds, self.rates = design, rounds, rates
        self.weights = [w for w, s in zip(weights, shares) if s > 0]
        self.shares = [float(s) for s in shares if s > 0]

    def chance(self) -> Column:
        """Probability of predicting 1, as a column expression."""
        parts = [F.when(self.design.margin(w) > 0, F.lit(s)).otherwise(F.lit(0.0)) for w, s in zip(self.weights, self.shares)]
        return functools.reduce(lambda a, b: a + b, parts)

    def transform(self, df: DataFrame, key: str, seed) -> DataFrame:
        """Add ``chance`` and a ``prediction`` drawn with it by a hash of the key, so that a second run predicts the same."""
        return df.withColumn("chance", self.chance()).withColumn("prediction", (fine_uniform(seed, key) < F.col("chance")).cast("double"))


def solve_game(payoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Best mixed rows (which pay), best mixed columns (which are paid) and the value of a small zero-sum game, by the simplex method."""
    n, k = payoff.shape
    shift = 1.0 - float(payoff.min())
    # Rows' shares over the value: the greatest sum such that no column is paid more than 1. The columns' are its prices.
    table = np.zeros((k + 1, n + k + 1))
    table[:k, :n], table[:k, n:n + k], table[:k, -1] = (payoff + shift).T, np.eye(k), 1.0
    table[k, :n] = -1.0
    basis = list(range(n, n + k))
    while True:
        entering = next((j for j in range(n + k) if table[k, j] < -1e-11), None)  # the first one, so that it cannot cycle
        if entering is None:
            break
        column = table[:k, entering]
        ratio = np.divide(table[:k, -1], column, out=np.full(k, math.inf), where=column > 1e-11)
        row = min(range(k), key=lambda i: (ratio[i], basis[i]))
        table[row] /= table[row, entering]
        for i in range(k + 1):
            if i != row:
                table[i] -= table[i, entering] * table[row]
        basis[row] = entering
    total = float(table[k, -1])
    rows = np.zeros(n + k)
    rows[basis] = table[:k, -1]
    return rows[:n] / total, np.maximum(table[k, n:n + k], 0) / total, 1.0 / total - shift


def train(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, group: str, bound: float = 0.01,
          c: float = 1.0, gap: float = 0.005, limit: float | None = None, step: float = 2.0, max_rounds: int = 30) -> Mixture:
    """Fit logistic regressions on the rows of ``df`` until their mixture is within ``gap`` of the best answer to its multipliers.

    Two kinds of round take turns: in one the multipliers follow the exponentiated gradient of the violations met so far, in the other they
    are those of the best mixture of the models at hand, so that its best answer bounds how much any further model could gain.
    ``c`` is the inverse strength of the L2 penalty, stated per data set. ``limit`` bounds the sum of the multipliers, ``1 / bound`` if not given.
    ``group`` may hold nulls, which are a group; groups are counted on the driver, one number each.
    """
    limit = limit or 1 / bound
    groups = [r[group] for r in df.select(group).distinct().orderBy(group).collect()]
    number = F.lit(0)
    for i, g in enumerate(groups):
        number = F.when(F.col(group).eqNullSafe(F.lit(g)), F.lit(i)).otherwise(number)
    kept = df.select(*dict.fromkeys([*numeric, *categorical, label, group])).persist()
    design = None
    try:
        design = Design(kept, numeric, categorical, number * 2 + (F.col(label) == 1).cast("int"), 2 * len(groups))
        design.rows = design.rows.persist()
        n, cells = design.n.sum(), design.n.reshape(-1, 2)
        share = cells.sum(1) / n

        def best_answer(multipliers: np.ndarray, start):
            """Weights, error and signed violations of the model that does best at these multipliers."""
            plus, minus = np.split(multipliers, 2)
            pull = plus - minus
            # What predicting 1 instead of 0 saves, by cell: the label's error, and the multipliers' price of the group.
            worth = np.array([[-1.0, 1.0]] * len(groups)) - (pull / share)[:, None] + pull.sum()
            weight = np.abs(worth).ravel() * n / max((np.abs(worth) * cells).sum(), 1e-300)
            found = fit_all(design, [Problem(weight, (worth.ravel() > 0).astype(int), 1 / (c * n))], starts=start, max_iter=10, tolerance=1e-3)[0]
            said = found.positives.reshape(-1, 2)
            wrong = (said[:, 0].sum() + (cells[:, 1] - said[:, 1]).sum()) / n
            over = said.sum(1) / np.maximum(cells.sum(1), 1) - said.sum() / n
            return found.weights, float(wrong), np.concatenate([over, -over]) - bound
        weights, errors, signed, rounds = [], [], [], []
        theta, multipliers, start, by_game = np.zeros(2 * len(groups)), np.zeros(2 * len(groups)), None, True
        while len(weights) < max_rounds:
            w, error, over = best_answer(multipliers, start)
            start = [w]
            weights.append(w)
            errors.append(error)
            signed.append(over)
            known_errors, known = np.array(errors), np.array(signed)
            if by_game:  # the bound belongs to the multipliers of the game before this model
                lower = float((known_errors + known @ multipliers).min())
                if rounds:
                    rounds[-1] = rounds[-1]._replace(lower=lower)
                    if rounds[-1].upper - lower <= gap:
                        break
            theta = theta + step / limit * over
            shares, columns, value = solve_game(known_errors[:, None] + limit * np.append(known, np.zeros((len(known), 1)), axis=1))
            if by_game and len(weights) > 1:
                powers = np.exp(theta - max(theta.max(), 0.0))
                multipliers, by_game = limit * powers / (math.exp(-max(theta.max(), 0.0)) + powers.sum()), False
            else:
                multipliers, by_game = limit * columns[:-1], True
                rounds.append(Round(float(shares @ known_errors), float((shares @ known).max()) + bound, -math.inf, value))
                answer = shares
        answer = np.append(answer, np.zeros(len(weights) - len(answer)))
        return Mixture(design, weights, answer, rounds, answer @ known[:, :len(groups)] + bound)
    finally:
        if design is not None:
            design.rows.unpersist()
        kept.unpersist()
