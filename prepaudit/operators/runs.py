"""Run logs, printed reports and verdicts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepaudit.functions.text import after_first, first_match, lines, number_after, sanitise_label, strip
from prepaudit.operators.distributed import running_total

# fixed values: patterns of printed metrics and the model names looked for, in this order
METRIC_PATTERNS = {
    "accuracy": r"(?i)accuracy[:\s]*([0-9]*\.?[0-9]+)",
    "precision": r"(?i)precision[:\s]*([0-9]*\.?[0-9]+)",
    "recall": r"(?i)recall[:\s]*([0-9]*\.?[0-9]+)",
    "f1_score": r"(?i)f1[:\s-]*score[:\s]*([0-9]*\.?[0-9]+)",
}
MODEL_TYPES = [
    ("RandomForest", ["RandomForestClassifier"]),
    ("LogisticRegression", ["LogisticRegression"]),
    ("SVM", ["SVC", "SVM"]),
    ("KNN", ["KNeighborsClassifier"]),
]
REPORT_HEADER = r"\bprecision\b.*\brecall\b.*\bf1-score\b"
REPORT_METRICS = ["precision", "recall", "f1-score", "support"]
VERDICT_SCHEMA = ("issue_detected: boolean, issue_fixed: boolean, false_positive: boolean, "
                  "description: struct<issue_detection: string, issue_fix: string, false_positive: string>")


def printed_metrics(output: Column) -> dict[str, Column]:
    """The first number after each metric name, and the model type."""
    found = {m: number_after(output, p) for m, p in METRIC_PATTERNS.items()}
    return {**found, "model_type": first_match(output, MODEL_TYPES)}


def run_differences(runs: DataFrame, case: str = "case", role: str = "role", left: str = "correct",
                    right: str = "generated") -> DataFrame:
    """Time and memory of both runs of a case and right minus left; a missing run counts 0 and as failed."""
    def of(side, column, default):
        return F.coalesce(F.max(F.when(F.col(role) == side, F.col(column))), F.lit(default))
    both = runs.groupBy(case).agg(*[
        of(side, column, default).alias(f"{column}_{side}")
        for column, default in (("execution_time", 0.0), ("memory_used_mb", 0.0), ("success", False))
        for side in (left, right)])
    return both.withColumns({f"{c}_diff": F.col(f"{c}_{right}") - F.col(f"{c}_{left}")
                             for c in ("execution_time", "memory_used_mb")})


def report_cells(reports: DataFrame, key: str, text: str = "report") -> DataFrame:
    """``(key, metric, value)`` for every numeric cell of a printed classification report.

    Columns are taken by position: a line ends with at most as many numbers as the header has columns, which belong to
    the last of them, and the label is everything before, also when it is a number itself.
    """
    rows = F.filter(lines(F.col(text)), lambda line: strip(line) != "")
    at = F.array_position(F.transform(rows, lambda line: line.rlike(REPORT_HEADER)), True)
    below = F.when(at > 0, F.slice(rows, (at + 1).cast("int"), F.size(rows)))
    parsed = reports.select(key, F.explode(below).alias("line"))
    tail = rf"((?:\s+[0-9]+(?:\.[0-9]+)?){{1,{len(REPORT_METRICS)}}})\s*$"
    label = sanitise_label(strip(F.regexp_replace("line", tail, "")))
    numbers = F.split(strip(F.regexp_extract("line", tail, 1)), r"\s+")
    parsed = parsed.select(key, label.alias("label"), numbers.alias("numbers"))
    names = F.array(*[F.lit(m) for m in REPORT_METRICS])
    offset = F.lit(len(REPORT_METRICS)) - F.size("numbers")
    cells = F.transform("numbers", lambda x, i: F.struct(
        F.get(names, i + offset).alias("name"), x.try_cast("double").alias("value")))
    return parsed.select(key, "label", F.inline(cells)).filter(F.col("value").isNotNull()).select(
        key, F.concat_ws("_", "label", "name").alias("metric"), "value")


def problem_log(logs: DataFrame, key: str, text: str = "log") -> DataFrame:
    """``(key, pipeline, changed_lines, problem, n)`` from blocks of a problem log.

    The text is cut at its block openings, so header values need not be carried
    over rows: no window and no shuffle.
    """
    blocks = after_first(F.split(F.concat(F.lit("\n"), F.col(text)), r"\nPipeline: ", -1))
    block = logs.select(key, F.explode(blocks).alias("block"))
    rows = F.filter(after_first(lines(F.col("block"))),
                    lambda line: line.rlike(r":\s*[0-9]+\s*$") & ~F.startswith(line, F.lit("Number of changed lines:")))
    parsed = block.select(
        key, strip(F.get(lines(F.col("block")), F.lit(0))).alias("pipeline"),
        F.regexp_extract("block", r"Number of changed lines: (\d+)", 1).try_cast("bigint").alias("changed_lines"),
        F.explode(rows).alias("line"))
    return parsed.select(key, "pipeline", "changed_lines",
                         strip(F.regexp_replace("line", r":\s*[0-9]+\s*$", "")).alias("problem"),
                         F.regexp_extract("line", r":\s*([0-9]+)\s*$", 1).cast("bigint").alias("n"))


def class_report(reports: DataFrame, key: str, text: str = "report") -> DataFrame:
    """``(key, class, declared_total, problem, n)`` from ``**class**`` headers and their detail lines.

    Repeated problems stay separate rows, so the declared total can be checked.
    """
    rows = lines(F.col(text))
    headed = F.split(F.concat(F.lit("\n"), F.array_join(rows, "\n")), r"\n(?=[^\n]*\*\*)", -1)
    blocks = reports.select(key, F.explode(after_first(headed)).alias("block"))
    head = F.get(F.split("block", "\n"), F.lit(0))
    name = F.replace(strip(F.replace(head, F.lit("**"), F.lit(""))), F.lit(":"), F.lit(""))
    body = F.filter(after_first(F.split("block", "\n")), lambda line: strip(line) != "")
    detail = blocks.select(key, name.alias("class"), F.explode(body).alias("line"))
    items = detail.select(
        key, "class", strip(F.substring_index("line", "—", -1)).try_cast("bigint").alias("declared_total"),
        F.explode(F.split(F.substring_index("line", "—", 1), ",")).alias("item"))
    return items.select(key, "class", "declared_total", strip(F.substring_index("item", ":", 1)).alias("problem"),
                        strip(F.substring_index("item", ":", -1)).try_cast("bigint").alias("n"))


def class_totals(classes: DataFrame, by: tuple = ("class",)) -> DataFrame:
    """Declared against added-up lines per class."""
    return classes.groupBy(*by).agg(F.max("declared_total").alias("declared_total"), F.sum("n").alias("summed")
                                    ).withColumn("agrees", F.col("declared_total") == F.col("summed"))


def parse_verdict(reply: Column) -> Column:
    """A JSON verdict as a struct; unreadable text gives the all-false verdict with an error.

    Read as a one-element list, because text after a valid object would pass unnoticed otherwise.
    """
    listed = F.from_json(F.concat(F.lit("["), reply, F.lit("]")), f"array<struct<{VERDICT_SCHEMA}>>")
    bad = F.coalesce(F.size(listed), F.lit(0)) != 1
    parsed = F.get(listed, F.lit(0))
    flags = ("issue_detected", "issue_fixed", "false_positive")
    notes = ("issue_detection", "issue_fix", "false_positive")
    failed = F.lit("Error processing")
    return F.struct(
        *[F.when(bad, F.lit(False)).otherwise(F.coalesce(parsed[f], F.lit(False))).alias(f) for f in flags],
        F.struct(*[F.when(bad, failed).otherwise(parsed["description"][n]).alias(n) for n in notes]).alias("description"),
        F.when(bad, F.lit("invalid JSON")).alias("error"))


def verdict_summary(verdicts: DataFrame, by: tuple = ()) -> DataFrame:
    """Counts and percentages of verdicts; expects the three flags and ``error``."""
    sums = verdicts.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if("issue_detected").alias("detected"),
        F.count_if("issue_fixed").alias("fixed"), F.count_if("false_positive").alias("false_positives"),
        F.count_if(F.col("error").isNotNull()).alias("errors"))
    rates = {f"{r}_rate": F.lit(100.0) * F.col(c) / F.col("total") for r, c in
             (("detection", "detected"), ("fix", "fixed"), ("false_positive", "false_positives"))}
    return sums.withColumns(rates)


def run_durations(runs: DataFrame, by: str = "status") -> DataFrame:
    """Runs per status and their duration in seconds, from epoch milliseconds; an open run has none."""
    seconds = (F.col("end_time") - F.col("start_time")) / F.lit(1000.0)
    return runs.groupBy(by).agg(
        F.count("*").alias("runs"), F.count("end_time").alias("ended"), F.avg(seconds).alias("mean_seconds"),
        F.min(seconds).alias("min_seconds"), F.max(seconds).alias("max_seconds"))


def before_after(scores: DataFrame, case: str, stage: str, score: str) -> DataFrame:
    """The score of each case before and after, side by side, and the gain."""
    wide = scores.groupBy(case).pivot(stage, ["before", "after"]).agg(F.avg(score))
    return wide.withColumn("gain", F.col("after") - F.col("before"))


def number_attempts(events: DataFrame, case: str, order: list[str]) -> DataFrame:
    """Number the attempts of each case from 1; a case with very many attempts spreads over tasks."""
    return running_total(events, [case], order, attempt=F.lit(1).cast("bigint"))


def attempts_to_success(events: DataFrame, case: str, order: list[str], success: Column, most: int = 5) -> DataFrame:
    """First successful attempt per case among the first ``most`` (the retry budget), else null, and how many of those there were.

    Spark keeps only the first ``most`` rows of a case in every task before anything moves.
    """
    numbered = events.withColumn("__attempt", F.row_number().over(Window.partitionBy(case).orderBy(*order)))
    return numbered.filter(F.col("__attempt") <= most).groupBy(case).agg(
        F.min(F.when(success, F.col("__attempt").cast("bigint"))).alias("succeeded_at"), F.count("*").alias("tried"))
