from __future__ import annotations

import difflib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prepaudit.functions import code, scoring, text
from prepaudit.operators import cases, pairs, runs

FEW = dict(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize("value", ["", "a", "a\n", "a\n\nb", "\n", "a\r\nb\rc\x0cd e", "a\n\n"])
def test_lines_split_like_python(spark, value):
    assert one(spark, value, text.lines) == value.splitlines()


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngrams_cover_the_whole_text(spark, n):
    value = "añ\nb😀cc"
    assert one(spark, value, lambda t: text.ngrams(t, n)) == [value[i:i + n] for i in range(len(value) - n + 1)]
    assert one(spark, "", lambda t: text.ngrams(t, n)) == []


def test_white_space_of_any_script(spark):
    value = "\u3000\x1c a\u00a0b \u2003c\n\x0b"
    assert one(spark, value, text.strip) == value.strip()
    assert one(spark, value, text.words) == value.split()
    assert one(spark, "a" + " " * 200_000 + "b", text.strip) == "a" + " " * 200_000 + "b"


def test_comment_lines_go(spark):
    assert one(spark, "a # x\n  # b\n#c\n\nd", text.strip_comment_lines) == "a # x\n\nd"


LINES = st.lists(st.sampled_from(["x = 1", "  y", "", "z"]), max_size=8).map("\n".join)


@settings(**FEW)
@given(LINES, LINES)
def test_similarity_is_the_upper_bound_of_matching(spark, a, b):
    df = spark.createDataFrame([(1, a, b), (2, b, a), (3, a, a)], "case long, left string, right string")
    kinds = {"line": text.lines, "char": pairs.char_pieces(1)}
    got = {r["case"]: r for r in pairs.similarities(df, kinds).collect()}
    assert got[1]["line"] == pytest.approx(difflib.SequenceMatcher(None, a.splitlines(), b.splitlines()).quick_ratio())
    assert got[1]["char"] == pytest.approx(difflib.SequenceMatcher(None, a, b).quick_ratio())
    assert got[1][1:] == got[2][1:] and got[3]["line"] == got[3]["char"] == 1.0


def test_changed_lines_never_exceed_the_diff(spark):
    a, b = "import x\n  a\n  b\nc\n", "import y\n  a\n  d\n  d\nc\n"
    got = pairs.changed_lines(spark.createDataFrame([(1, a, b)], "case long, left string, right string")).first()
    diff = list(difflib.unified_diff(a.splitlines(), b.splitlines()))[2:]
    assert (got["added"], got["removed"], got["indented_changed"]) == (3, 2, 3)
    assert got["changed"] <= sum(d[0] in "+-" for d in diff)


def test_unchanged_and_empty_pairs_stay(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "", ""), (3, None, "x")], "case long, left string, right string")
    assert {r["case"]: r["changed"] for r in pairs.changed_lines(df).collect()} == {1: 0, 2: 0, 3: 1}
    assert {r["case"]: r["line_similarity"] for r in pairs.line_similarity(df).collect()} == {1: 1.0, 2: 1.0, 3: 0.0}


def test_structure_of_an_empty_text_is_a_sentinel(spark):
    df = spark.createDataFrame([(1, " ", "One. Two!\nthree")], "case long, left string, right string")
    got = pairs.structure_diff(df).first()
    assert (got["words_left"], got["words_right"], got["lines_diff"], got["sentences_right"]) == (-1, 3, 3, 2)


SCRIPT = """import os, numpy as np
from sklearn.preprocessing import StandardScaler, OneHotEncoder as E  # why
from a.b import (c,
    d as e)
x = x.str.lower()
model = RandomForestClassifier(n_estimators=3, random_state=7)
"""


def test_script_patterns(spark):
    assert one(spark, SCRIPT, code.imports) == [
        "os", "numpy", "sklearn.preprocessing.StandardScaler", "sklearn.preprocessing.OneHotEncoder", "a.b.c", "a.b.d"]
    assert one(spark, SCRIPT, code.sklearn_components) == ["preprocessing.StandardScaler", "preprocessing.OneHotEncoder as E"]
    assert one(spark, SCRIPT, code.preprocessing_steps) == ["text_lowercasing", "standard_scaling", "onehot_encoding"]
    assert one(spark, SCRIPT, code.forest_seed) == "7"
    assert one(spark, "RandomForestClassifier(random_state=seed)", code.forest_seed) == "True"
    assert one(spark, "RandomForestClassifier()", code.forest_seed) is None


def test_issues_and_components(spark):
    right = "from sklearn.preprocessing import Normalizer\nx.str.replace('a', 'b')\nRandomForestClassifier()"
    df = spark.createDataFrame([(1, SCRIPT, right), (2, SCRIPT, SCRIPT)], "case long, left string, right string")
    got = {r["case"]: r for r in pairs.components(df).collect()}
    assert got[1]["issues"] == [code.ISSUE_SCALER, code.ISSUE_TAGS[1][1], code.ISSUE_SEED] and got[2]["issues"] == []
    assert got[1]["preprocessing"]["differences"]["extra"] == ["text_replacement", "sample_normalization"]
    assert got[1]["model_params"]["left"] == {"random_state": "7"} and got[1]["model_params"]["right"] == {}


def test_list_differences_keep_repeats(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"], ["c", "d", "d"])], "l array<string>, r array<string>")
    got = df.select(code.differences(F.col("l"), F.col("r")).alias("d")).select("d.*").first()
    assert (got["missing"], got["extra"]) == (["a", "b", "a"], ["d", "d"])


@pytest.mark.parametrize("score, label", [(9.0, "Excellent"), (8.5, "Excellent"), (7.0, "Good"), (5.0, "Acceptable"),
                                          (3.0, "Poor"), (2.99, "Unacceptable")])
def test_verdict_bands(spark, score, label):
    assert one(spark, score, scoring.verdict, "double") == label


def test_partial_scores(spark):
    row = spark.range(1).select(
        scoring.quality_ratio(F.lit(0.0), F.lit(5.0)).alias("none"), scoring.quality_ratio(F.lit(2.0), F.lit(9.0)).alias("cap"),
        scoring.correctness_score(F.lit(7)).alias("floor"), scoring.execution_score(F.lit(True), F.lit(False)).alias("lost"),
        scoring.execution_score(F.lit(False), F.lit(True)).alias("won"),
        scoring.execution_score(F.lit(None).cast("boolean"), F.lit(None).cast("boolean")).alias("unknown")).first()
    assert tuple(row) == (1.0, 2.0, 0.0, 0.0, 1.5, 1.0)


def test_templates_blocks_and_titles(spark):
    filled = one(spark, "x = 1", lambda t: text.fill_template("do ##A##!", {"##A##": t}))
    assert filled == "do x = 1!" and one(spark, filled, text.token_estimate) == 6
    assert one(spark, "a\n```python\nx\ny\n```\n```python\nz```", text.fenced_block) == "x\ny\n"
    assert one(spark, "no block", text.fenced_block) is None
    assert one(spark, "\n A: x\n B : y: z\n", text.line_titles) == ["A", "B"]
    assert one(spark, "A: x\n\n B : y: z", text.line_titles) == []
    assert one(spark, " \n", text.line_titles) == []
    assert one(spark, "A: x\nno mark", text.line_titles) == []
    assert one(spark, "salary >=50K, <x>!", text.sanitise_label) == "salary_ge_50K_lt_xgt"


def test_complete_and_pending_cases(spark):
    rows = [("a", "original", "1"), ("a", "fixed", "2"), ("b", "original", "#c\nx"), ("a", "other", "3")]
    df = spark.createDataFrame(rows, "case string, role string, text string")
    assert [tuple(r) for r in cases.complete_cases(df, ["original", "fixed"]).collect()] == [("a", "1", "2")]
    inputs, outputs = df.filter("role = 'original'"), df.filter("role = 'fixed'")
    assert [(r["case"], r["text"]) for r in cases.pending_cases(inputs, outputs).collect()] == [("b", "x")]


def test_printed_metrics(spark):
    output = "Accuracy: 0.85\naccuracy 0.1\nF1-Score: .5\nSVC and KNeighborsClassifier"
    df = spark.createDataFrame([(output,), ("nothing",)], "o string")
    got = df.select(*[c.alias(k) for k, c in runs.printed_metrics(F.col("o")).items()]).collect()
    assert tuple(got[0]) == (0.85, None, None, 0.5, "SVM") and tuple(got[1]) == (None,) * 5


REPORT = """Accuracy: 0.9
              precision    recall  f1-score   support

       <=50K       0.90      0.95      0.92      4976
        >50K       0.80      0.70      0.75      1537

    accuracy                           0.88      6513
   macro avg       0.85      0.82      0.83      6513
weighted avg       0.87      0.88      0.88      6513
"""


def test_printed_report_is_read_back(spark):
    df = spark.createDataFrame([(1, REPORT), (2, "no report")], "id long, report string")
    got = {r["metric"]: r["value"] for r in runs.report_cells(df, "id").collect()}
    assert got["le_50K_precision"] == 0.9 and got["gt_50K_recall"] == 0.7 and got["macro_avg_f1-score"] == 0.83
    assert got["accuracy_f1-score"] == 0.88 and got["accuracy_support"] == 6513 and "accuracy_precision" not in got


def test_problem_log_carries_its_headers(spark):
    log = ("Pipeline: p\\one\nNumber of changed lines: 16\nDifferences:\nPaths: 7\nUse 'a': b: 2\n"
           "Pipeline: two\nNumber of changed lines: 2\nDifferences:\nSplit: 1\n")
    got = [tuple(r)[1:] for r in runs.problem_log(spark.createDataFrame([(1, log)], "id long, log string"), "id").collect()]
    assert got == [("p\\one", 16, "Paths", 7), ("p\\one", 16, "Use 'a': b", 2), ("two", 2, "Split", 1)]


def test_class_report_and_totals(spark):
    text_ = "**Data**:\n A: 2, B: 3, A: 1 — 9\n\n**Leak**: Prevention:\n 14, C: 4 — 18\n"
    parsed = runs.class_report(spark.createDataFrame([(1, text_)], "id long, report string"), "id")
    assert [tuple(r)[1:] for r in parsed.collect()] == [
        ("Data", 9, "A", 2), ("Data", 9, "B", 3), ("Data", 9, "A", 1),
        ("Leak Prevention", 18, "14", 14), ("Leak Prevention", 18, "C", 4)]
    totals = {r["class"]: (r["declared_total"], r["summed"], r["agrees"]) for r in runs.class_totals(parsed).collect()}
    assert totals == {"Data": (9, 6, False), "Leak Prevention": (18, 18, True)}


def test_verdicts_are_parsed_or_defaulted_and_summed(spark):
    good = json.dumps({"issue_detected": True, "issue_fixed": False, "false_positive": True,
                       "description": {"issue_detection": "a", "issue_fix": "b", "false_positive": "c"}})
    replies = [good, good + " and more", "", "[]", "{}"]
    df = spark.createDataFrame([(r,) for r in replies], "r string").select(runs.parse_verdict(F.col("r")).alias("v")).select("v.*")
    got = df.collect()
    assert got[0]["issue_detected"] and got[0]["description"]["issue_fix"] == "b" and got[0]["error"] is None
    assert [r["error"] is None for r in got] == [True, False, False, False, True]
    assert got[1]["description"]["issue_fix"] == "Error processing" and not got[4]["issue_detected"]
    total = runs.verdict_summary(df).first()
    assert (total["total"], total["detected"], total["errors"], total["detection_rate"]) == (5, 1, 3, 20.0)


def test_runs_compare_and_last(spark):
    df = spark.createDataFrame([("a", "correct", 1.0, 5.0, True), ("a", "generated", 3.0, 4.0, False),
                                ("b", "generated", 2.0, 1.0, True)],
                               "case string, role string, execution_time double, memory_used_mb double, success boolean")
    got = {r["case"]: (r["execution_time_diff"], r["memory_used_mb_diff"], r["success_correct"])
           for r in runs.run_differences(df).collect()}
    assert got == {"a": (2.0, -1.0, True), "b": (2.0, 1.0, False)}
    lasting = spark.createDataFrame([(3, 1000, 3500), (3, 0, 500), (1, 0, None)], "status int, start_time long, end_time long")
    assert {r["status"]: (r["runs"], r["ended"], r["mean_seconds"]) for r in runs.run_durations(lasting).collect()} == {
        3: (2, 2, 1.5), 1: (1, 0, None)}


def test_attempts_are_numbered_and_capped(spark):
    events = spark.createDataFrame([("a", t, t == 3) for t in range(1, 5)] + [("b", t, t == 7) for t in range(1, 9)],
                                   "case string, at long, ok boolean")
    assert {(r["case"], r["at"]) for r in runs.number_attempts(events, "case", ["at"]).filter("attempt = at").collect()} == {
        ("a", t) for t in range(1, 5)} | {("b", t) for t in range(1, 9)}
    got = {r["case"]: (r["succeeded_at"], r["tried"]) for r in
           runs.attempts_to_success(events, "case", ["at"], F.col("ok")).collect()}
    assert got == {"a": (3, 4), "b": (None, 5)}


def test_script_pairs_are_dealt_out_by_rows(spark, tmp_path, monkeypatch):
    """One row group is one task of a scan; reading its scripts is dealt out to as many tasks as its rows need."""
    from prepaudit.plans import inputs
    spark.range(1000).selectExpr("id AS o_orderkey", "id AS o_custkey", "'F' AS o_orderstatus", "'1-URGENT' AS o_orderpriority").coalesce(1).write.parquet(
        str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(inputs, "SCRIPTS_AT_ONCE", 20)
    sizes = [len(x) for x in inputs.script_pairs(spark, str(tmp_path)).select("case").rdd.glom().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 50 and max(sizes) <= 40
