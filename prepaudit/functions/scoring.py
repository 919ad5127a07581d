"""Weighted score of a compared pair and its verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: weights, deduction, execution scores and verdict bands
CHAR_WEIGHT, LINE_WEIGHT = 0.7, 0.3
SIMILARITY, QUALITY, CORRECTNESS, EXECUTION = 0.25, 0.20, 0.30, 0.25
DEDUCTION = 0.2
MAX_QUALITY_RATIO = 2.0
BOTH_RAN, ONLY_LEFT_RAN, ONLY_RIGHT_RAN, NONE_RAN = 1.0, 0.0, 1.5, 0.5
VERDICTS = [(8.5, "Excellent"), (7.0, "Good"), (5.0, "Acceptable"), (3.0, "Poor")]
LOWEST_VERDICT = "Unacceptable"


def similarity_score(char_similarity: Column, line_similarity: Column) -> Column:
    return F.lit(CHAR_WEIGHT) * char_similarity + F.lit(LINE_WEIGHT) * line_similarity


def quality_ratio(left: Column, right: Column) -> Column:
    """Right over left between 0 and 2; 1 without a positive left score."""
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(MAX_QUALITY_RATIO), right / F.nullif(left, F.lit(0.0))))
    return F.when(left > 0, ratio).otherwise(F.lit(1.0))


def correctness_score(issue_count: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - issue_count * F.lit(DEDUCTION))


def execution_score(left_ran: Column, right_ran: Column) -> Column:
    """1 when no run is known."""
    score = (F.when(left_ran & right_ran, F.lit(BOTH_RAN)).when(left_ran & ~right_ran, F.lit(ONLY_LEFT_RAN))
             .when(~left_ran & right_ran, F.lit(ONLY_RIGHT_RAN)).when(~left_ran & ~right_ran, F.lit(NONE_RAN)))
    return F.coalesce(score, F.lit(1.0))


def overall_score(similarity: Column, quality: Column, correctness: Column, execution: Column) -> Column:
    return (F.lit(SIMILARITY) * similarity + F.lit(QUALITY) * quality + F.lit(CORRECTNESS) * correctness
            + F.lit(EXECUTION) * execution) * F.lit(10.0)


def verdict(score: Column) -> Column:
    banded = F.lit(LOWEST_VERDICT)
    for edge, label in reversed(VERDICTS):
        banded = F.when(score >= F.lit(edge), F.lit(label)).otherwise(banded)
    return banded
