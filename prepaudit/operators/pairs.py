"""Comparing two texts per case, as counted pieces instead of per-pair matching.

A frame of pairs has one row per ``case`` with the texts ``left`` and ``right``.
Pieces (lines or character n-grams) of both are counted inside the row by an Arrow kernel, so no text and no
piece is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepaudit.functions import code, multiset, scoring, text


def char_pieces(n: int) -> int:
    """The character n-grams of a text, as a kind of piece."""
    return n


def dice(kind, left: Column, right: Column) -> Column:
    """Multiset Dice coefficient: shared pieces twice over all pieces; 1 for two empty texts.

    A kind is a number of characters, or a function from a text to its pieces.
    """
    if isinstance(kind, int):
        return multiset.dice_of_grams(left, right, kind)
    return multiset.dice_of_pieces(kind(left), kind(right))


def similarities(pairs: DataFrame, kinds: Mapping, case: str = "case") -> DataFrame:
    """One column per kind, counted inside the row: no shuffle."""
    return pairs.select(case, *[dice(kind, F.col("left"), F.col("right")).alias(name) for name, kind in kinds.items()])


def line_similarity(pairs: DataFrame, case: str = "case") -> DataFrame:
    return similarities(pairs, {"line_similarity": text.lines}, case)


def char_similarity(pairs: DataFrame, n: int = 1, case: str = "case") -> DataFrame:
    return similarities(pairs, {"char_similarity": char_pieces(n)}, case)


def changed_lines(pairs: DataFrame, case: str = "case") -> DataFrame:
    """Lines added and removed between the sides as multisets, over all lines and over indented ones."""
    found = pairs.select(case, multiset.changes(
        text.lines(F.col("left")), text.lines(F.col("right")), lambda line: line.startswith(" ")).alias("c"))
    return found.select(case, "c.added", "c.removed", F.col("c.marked").alias("indented_changed"),
                        (F.col("c.added") + F.col("c.removed")).alias("changed"))


def structure(column: Column) -> Column:
    """Size of a text as lines, words and sentences; -1 for an empty one."""
    counts = {"lines": F.size(text.lines(column)), "words": F.size(text.words(column)),
              "sentences": F.size(F.regexp_extract_all(column, F.lit(r"[.!?]+"), F.lit(0)))}
    known = F.size(text.words(column)) > 0
    return F.struct(*[F.when(known, c).otherwise(F.lit(-1)).alias(k) for k, c in counts.items()])


def structure_diff(pairs: DataFrame, case: str = "case") -> DataFrame:
    sized = pairs.select(case, structure(F.col("left")).alias("l"), structure(F.col("right")).alias("r"))
    parts = ("lines", "words", "sentences")
    return sized.select(case, *[F.col(f"{s}.{p}").alias(f"{p}_{n}") for p in parts for s, n in
                                (("l", "left"), ("r", "right"))],
                        *[(F.col(f"r.{p}") - F.col(f"l.{p}")).alias(f"{p}_diff") for p in parts])


KINDS = ("imports", "sklearn_components", "preprocessing")


def extracted(pairs: DataFrame, case: str = "case") -> DataFrame:
    """What both scripts of a pair contain, a column per kind and side."""
    return pairs.select(case, *[c.alias(name) for side in ("left", "right")
                                for name, c in code.extracted(F.col(side), side).items()])


def components(pairs: DataFrame, case: str = "case") -> DataFrame:
    """Extracted lists of both sides and their differences, one struct per kind, and the issues found."""
    found = extracted(pairs, case)
    return found.select(case, *[
        F.struct(F.col(f"{k}_left").alias("left"), F.col(f"{k}_right").alias("right"),
                 code.differences(F.col(f"{k}_left"), F.col(f"{k}_right")).alias("differences")).alias(k) for k in KINDS],
        F.struct(*[code.model_parameters(F.col(f"seed_{s}")).alias(s) for s in ("left", "right")]).alias("model_params"),
        code.issues().alias("issues"))


def issues(pairs: DataFrame, case: str = "case") -> DataFrame:
    """``(case, issues)``."""
    return extracted(pairs, case).select(case, code.issues().alias("issues"))


def report_general(pairs: DataFrame, runs: DataFrame, ngram: int = 1, case: str = "case") -> DataFrame:
    """One row per case: similarities, size difference, issues and the compared runs."""
    left, right = F.col("left"), F.col("right")
    kinds = {"line_similarity": text.lines, "char_similarity": char_pieces(ngram)}
    alike = pairs.withColumns({name: dice(kind, left, right) for name, kind in kinds.items()})
    base = alike.select(case, *kinds, (F.size(text.words(right)) - F.size(text.words(left))).alias("structure_diff"),
                        *[c.alias(name) for side in ("left", "right")
                          for name, c in code.extracted(F.col(side), side).items()])
    joined = base.select(case, *kinds, "structure_diff", code.issues().alias("__issues")).join(runs, case, "left")
    return joined.withColumns({"issue_count": F.size("__issues"), "issues": F.array_join("__issues", "; ")}).drop(
        "__issues")


def report_components(pairs: DataFrame, case: str = "case") -> DataFrame:
    """One row per case: what each side lacks and adds, as lines of text."""
    found = extracted(pairs, case)
    sides = {"extra": ("right", "left"), "missing": ("left", "right")}
    return found.select(case, *[
        F.array_join(text.not_in(F.col(f"{kind}_{a}"), F.col(f"{kind}_{b}")), "\n").alias(f"{name}_{kind}")
        for kind in KINDS for name, (a, b) in sides.items()])


def assess(report: DataFrame, quality_left: Column, quality_right: Column, left_ran: Column,
           right_ran: Column) -> DataFrame:
    """Add the partial scores, the overall score and the verdict to a general report."""
    scores = {
        "similarity_score": scoring.similarity_score(F.col("char_similarity"), F.col("line_similarity")),
        "quality_ratio": scoring.quality_ratio(quality_left, quality_right),
        "ml_correctness_score": scoring.correctness_score(F.col("issue_count")),
        "execution_score": scoring.execution_score(left_ran, right_ran)}
    scored = report.withColumns(scores)
    total = scoring.overall_score(*[F.col(c) for c in scores])
    return scored.withColumn("overall_score", total).withColumn("verdict", scoring.verdict(F.col("overall_score")))
