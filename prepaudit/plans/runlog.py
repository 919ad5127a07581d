"""Run logs, printed reports and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepaudit.functions.text import sanitise_label
from prepaudit.operators import metrics, runs
from prepaudit.plans.audit import _report_sql
from prepaudit.plans.inputs import (LABELLED_SQL, RUNS_SQL, SCORED_SQL, event_runs, labelled, lines_sql, rounded, scored,
                                    strip_sql, table, wide_table)
from prepaudit.plans.registry import query

# What a run printed, from its event.
OUTPUT = """concat('model: ', CASE event_type WHEN 'click' THEN 'RandomForestClassifier()' WHEN 'view' THEN 'SVC then KNeighborsClassifier'
    WHEN 'signup' THEN 'KNeighborsClassifier' WHEN 'error' THEN 'none' ELSE 'LogisticRegression' END, chr(10),
    CASE WHEN event_type <> 'error' THEN concat('Accuracy:  0.', event_id, chr(10), 'accuracy 0.5') ELSE 'Traceback' END, chr(10),
    CASE WHEN event_type = 'view' THEN concat('PRECISION: .', user_id, ' recall ', user_id, ' F1-score: 0.', user_id) ELSE '' END)"""


def _metric_sql(name: str) -> str:
    return f"try_cast(nullif(regexp_extract(o, '{runs.METRIC_PATTERNS[name]}', 1), '') AS DOUBLE) AS {name}"


@query("extract_metrics", f"""
    WITH e AS (SELECT event_id, {OUTPUT} AS o FROM events)
    SELECT event_id, {', '.join(_metric_sql(m) for m in runs.METRIC_PATTERNS)},
        CASE WHEN contains(o, 'RandomForestClassifier') THEN 'RandomForest'
             WHEN contains(o, 'LogisticRegression') THEN 'LogisticRegression'
             WHEN contains(o, 'SVC') OR contains(o, 'SVM') THEN 'SVM'
             WHEN contains(o, 'KNeighborsClassifier') THEN 'KNN' END AS model_type FROM e""")
def extract_metrics(spark, folder):
    printed = table(spark, folder, "events").select("event_id", F.expr(OUTPUT).alias("output"))
    found = runs.printed_metrics(F.col("output"))
    return printed.select("event_id", *[v.alias(k) for k, v in found.items()])


def _run_sql(column: str, role: str, default: str) -> str:
    return f"coalesce(max({column}) FILTER (role = '{role}'), {default}) AS {column}_{role}"


@query("run_diff", f"""
    WITH {RUNS_SQL}, b AS (SELECT "case", """ + ", ".join(
    _run_sql(c, r, d) for c, d in (("execution_time", "0"), ("memory_used_mb", "0"), ("success", "false"))
    for r in ("correct", "generated")) + """ FROM runs GROUP BY "case")
    SELECT *, round(execution_time_generated - execution_time_correct, 6) AS execution_time_diff,
           round(memory_used_mb_generated - memory_used_mb_correct, 6) AS memory_used_mb_diff FROM b""")
def run_diff(spark, folder):
    return rounded(runs.run_differences(event_runs(spark, folder)))


@query("parse_report_text", f"""
    WITH {SCORED_SQL}, judged AS (SELECT lang, CASE quality WHEN 1 THEN '>=good' ELSE '<bad, not good' END AS y,
                                  CASE pred WHEN 1 THEN '>=good' ELSE '<bad, not good' END AS p FROM scored),
    {_report_sql('judged', 'lang')},
    named AS (SELECT *, CASE label WHEN '>=good' THEN 'ge_good' WHEN '<bad, not good' THEN 'lt_bad_not_good'
                        ELSE replace(label, ' ', '_') END AS name FROM report),
    long AS (SELECT lang, concat(name, '_precision') AS metric, precision AS value FROM named UNION ALL
              SELECT lang, concat(name, '_recall'), recall FROM named UNION ALL
              SELECT lang, concat(name, '_f1-score'), f1_score FROM named UNION ALL
              SELECT lang, concat(name, '_support'), actual FROM named)
    SELECT lang, metric, round(value, 4) AS value FROM long WHERE value IS NOT NULL""")
def parse_report_text(spark, folder):
    """Prints a report per language as text and reads the text back."""
    return _printed_and_read(spark, folder, ">=good", "<bad, not good")


def _printed_and_read(spark, folder, good, bad):
    words = {f"{c}_text": F.when(F.col(c) == 1, good).otherwise(bad) for c in ("quality", "pred")}
    report = metrics.classification_report(scored(spark, folder).withColumns(words), "quality_text", "pred_text", ["lang"])

    def cell(column, shape="%.4f"):
        return F.lpad(F.coalesce(F.format_string(shape, column), F.lit("")), 11, " ")
    numbers = [F.when(F.col(c).isNull(), F.lit(" " * 11)).otherwise(cell(F.round(c, 4))) for c in
               ("precision", "recall", "f1_score")]
    order = F.when(F.col("label") == "accuracy", 1).when(F.col("label").endswith("avg"), 2).otherwise(0)
    line = F.concat(F.lpad("label", 20, " "), *numbers, cell(F.col("support"), "%d"))
    header = F.lit(f"Results\n\n{'':20}{'precision':>11}{'recall':>11}{'f1-score':>11}{'support':>11}\n\n")
    # one line per class and summary: the list is as short as the class list
    printed = report.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return runs.report_cells(printed.select("lang", F.concat(header, body).alias("report")), "lang")


# The same with classes that are numbers themselves.
@query("parse_report_classes", f"""
    WITH {SCORED_SQL}, judged AS (SELECT lang, quality::VARCHAR AS y, pred::VARCHAR AS p FROM scored),
    {_report_sql('judged', 'lang')},
    named AS (SELECT *, replace(label, ' ', '_') AS name FROM report),
    long AS (SELECT lang, concat(name, '_precision') AS metric, precision AS value FROM named UNION ALL
              SELECT lang, concat(name, '_recall'), recall FROM named UNION ALL
              SELECT lang, concat(name, '_f1-score'), f1_score FROM named UNION ALL
              SELECT lang, concat(name, '_support'), actual FROM named)
    SELECT lang, metric, round(value, 4) AS value FROM long WHERE value IS NOT NULL""")
def parse_report_classes(spark, folder):
    return _printed_and_read(spark, folder, "1", "0")


LABEL = "concat('>=', o_orderstatus, ' <', o_orderpriority, '!! (>', chr(9), o_orderstatus, ')_')"


@query("sanitize_label", rf"""
    WITH l AS (SELECT o_orderkey, replace(replace(replace(replace({LABEL}, '>=', 'ge_'), '>', 'gt_'), '<=', 'le_'), '<', 'lt_')
               AS s FROM orders)
    SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\s+', '_', 'g'),
        '[^A-Za-z0-9_\-./ ]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS label FROM l""")
def sanitize_label(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", sanitise_label(F.expr(LABEL)).alias("label"))


@query("verdict_summary", """
    WITH v AS (SELECT lang, coalesce(quality = 0, false) AS detected, coalesce(quality = 1 AND toxic = 0, false) AS fixed,
                      coalesce(toxic = 1, false) AS false_positive, quality IS NULL AS error
               FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    s AS (SELECT lang, count(*) AS total, count(*) FILTER (detected) AS detected, count(*) FILTER (fixed) AS fixed,
                 count(*) FILTER (false_positive) AS false_positives, count(*) FILTER (error) AS errors FROM v GROUP BY lang)
    SELECT *, round(100.0::DOUBLE * detected / total, 6) AS detection_rate, round(100.0::DOUBLE * fixed / total, 6) AS fix_rate,
           round(100.0::DOUBLE * false_positives / total, 6) AS false_positive_rate FROM s""")
def verdict_summary(spark, folder):
    documents = table(spark, folder, "documents", "doc_id", "lang").join(table(spark, folder, "labels"), "doc_id", "left")

    def flag(condition):
        return F.coalesce(condition, F.lit(False))
    quality, toxic = F.col("quality"), F.col("toxic")
    verdicts = documents.select("lang", flag(quality == 0).alias("issue_detected"),
                                flag((quality == 1) & (toxic == 0)).alias("issue_fixed"),
                                flag(toxic == 1).alias("false_positive"),
                                F.when(quality.isNull(), F.lit("no verdict")).alias("error"))
    return rounded(runs.verdict_summary(verdicts, ("lang",)))


REPLY = """CASE event_type WHEN 'error' THEN concat(props, ' sorry') WHEN 'view' THEN props
    ELSE concat('{"issue_detected": ', CASE WHEN value > 20 THEN 'true' ELSE 'false' END, ', "issue_fixed": ',
                CASE WHEN value > 50 THEN 'true' ELSE 'false' END, ', "description": {"issue_fix": "', event_type, '"}}') END"""


@query("parse_json_or_default", f"""
    WITH r AS (SELECT event_id, {REPLY} AS r FROM events), p AS (SELECT event_id, json_valid(r) AS ok,
        CASE WHEN json_valid(r) THEN r ELSE '{{}}' END AS j FROM r)
    SELECT event_id, coalesce(json_extract_string(j, '$.issue_detected') = 'true', false) AS issue_detected,
        coalesce(json_extract_string(j, '$.issue_fixed') = 'true', false) AS issue_fixed,
        coalesce(json_extract_string(j, '$.false_positive') = 'true', false) AS false_positive,
        CASE WHEN ok THEN json_extract_string(j, '$.description.issue_fix') ELSE 'Error processing' END AS issue_fix,
        CASE WHEN NOT ok THEN 'invalid JSON' END AS error FROM p""")
def parse_json_or_default(spark, folder):
    events = table(spark, folder, "events", "event_id", "event_type", "value", "props")
    parsed = events.select("event_id", runs.parse_verdict(F.expr(REPLY)).alias("v"))
    return parsed.select("event_id", "v.issue_detected", "v.issue_fixed", "v.false_positive",
                         F.col("v.description.issue_fix").alias("issue_fix"), "v.error")


LOG = """concat('Pipeline: orders/', o_orderkey, chr(10), 'Number of changed lines: ', o_custkey, chr(10), 'Differences:',
    chr(10), 'Status ', o_orderstatus, ': fixed: ', o_custkey, chr(10), 'a note', chr(10), o_orderpriority, ': 3', chr(10),
    'Pipeline: customers/', o_custkey, chr(10), 'Number of changed lines: 7', chr(10), 'Differences:', chr(10),
    CASE WHEN o_orderstatus = 'F' THEN concat('Fragile paths: ', length(o_orderpriority)) ELSE 'nothing' END)"""


@query("log_blocks", rf"""
    WITH t AS (SELECT o_orderkey, unnest(string_split({LOG}, chr(10))) AS line,
                      generate_subscripts(string_split({LOG}, chr(10)), 1) AS pos FROM orders),
    f AS (SELECT *, last_value(CASE WHEN starts_with(line, 'Pipeline: ') THEN line[11:] END IGNORE NULLS) OVER w AS pipeline,
                 last_value(CASE WHEN starts_with(line, 'Number of changed lines: ') THEN line[26:]::BIGINT END IGNORE NULLS)
                     OVER w AS changed_lines FROM t WINDOW w AS (PARTITION BY o_orderkey ORDER BY pos))
    SELECT o_orderkey, pipeline, changed_lines, regexp_replace(line, ':\s*[0-9]+\s*$', '') AS problem,
           regexp_extract(line, ':\s*([0-9]+)\s*$', 1)::BIGINT AS n FROM f
    WHERE regexp_matches(line, ':\s*[0-9]+\s*$') AND NOT starts_with(line, 'Pipeline: ')
        AND NOT starts_with(line, 'Number of changed lines: ')""")
def log_blocks(spark, folder):
    logs = wide_table(spark, folder, "orders").select("o_orderkey", F.expr(LOG).alias("log"))
    return runs.problem_log(logs, "o_orderkey")


CLASSES = """concat('**Handling: ', o_orderstatus, '**:', chr(10), ' Missing values: ', o_custkey, ', Odd (x) y: 2, Missing values: 5 — ',
    o_custkey + CASE WHEN o_orderpriority < '3' THEN 7 ELSE 2 END, chr(10), chr(10), '**Structure**:', chr(10), ' No guard: 3 — 3')"""
CLASS_SQL = f"""t AS (SELECT o_orderkey, unnest(string_split({CLASSES}, chr(10))) AS line,
                      generate_subscripts(string_split({CLASSES}, chr(10)), 1) AS pos FROM orders),
    f AS (SELECT *, last_value(CASE WHEN contains(line, '**') THEN replace({strip_sql("replace(line, '**', '')")}, ':', '') END
                 IGNORE NULLS) OVER (PARTITION BY o_orderkey ORDER BY pos) AS class FROM t),
    d AS (SELECT o_orderkey, class, {strip_sql("split_part(line, '—', 2)")}::BIGINT AS declared_total,
                 unnest(string_split(split_part(line, '—', 1), ',')) AS item
          FROM f WHERE NOT contains(line, '**') AND {strip_sql('line')} <> ''),
    classes AS (SELECT o_orderkey, class, declared_total, {strip_sql("split_part(item, ':', 1)")} AS problem,
                       {strip_sql("split_part(item, ':', -1)")}::BIGINT AS n FROM d)"""


def _class_report(spark, folder):
    reports = wide_table(spark, folder, "orders").select("o_orderkey", F.expr(CLASSES).alias("report"))
    return runs.class_report(reports, "o_orderkey")


@query("class_report_parse", f"WITH {CLASS_SQL} SELECT o_orderkey, class, declared_total, problem, n FROM classes")
def class_report_parse(spark, folder):
    return _class_report(spark, folder)


@query("class_totals", f"""
    WITH {CLASS_SQL} SELECT o_orderkey, class, max(declared_total) AS declared_total, sum(n)::BIGINT AS summed,
        max(declared_total) = sum(n) AS agrees FROM classes GROUP BY o_orderkey, class""")
def class_totals(spark, folder):
    return runs.class_totals(_class_report(spark, folder), ("o_orderkey", "class"))


@query("run_durations", """
    WITH r AS (SELECT CASE event_type WHEN 'error' THEN 4 WHEN 'signup' THEN 1 ELSE 3 END AS status,
                      epoch_ms(ts) AS s, CASE WHEN event_type <> 'signup' THEN epoch_ms(ts) + floor(value * 1000)::BIGINT END AS e
               FROM events)
    SELECT status, count(*) AS runs, count(e) AS ended, round(avg((e - s) / 1000.0::DOUBLE), 6) AS mean_seconds,
           round(min((e - s) / 1000.0::DOUBLE), 6) AS min_seconds, round(max((e - s) / 1000.0::DOUBLE), 6) AS max_seconds
    FROM r GROUP BY status""")
def run_durations(spark, folder):
    events = table(spark, folder, "events", "ts", "event_type", "value")
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "signup", 1).otherwise(3)
    end = F.when(F.col("event_type") != "signup", start + F.floor(F.col("value") * 1000))
    return rounded(runs.run_durations(events.select(
        status.alias("status"), start.alias("start_time"), end.alias("end_time"))))


@query("run_outcomes", f"""
    WITH {SCORED_SQL} SELECT lang, round(avg((quality = 1)::INT), 6) AS before, round(avg((quality = pred)::INT), 6) AS after,
        round(avg((quality = pred)::INT) - avg((quality = 1)::INT), 6) AS gain FROM scored GROUP BY lang""")
def run_outcomes(spark, folder):
    """A metric of the original and of the improved run side by side: always guessing 1 against the rule."""
    rows = scored(spark, folder).withColumn("guess", F.lit(1))
    before = metrics.accuracy(rows, "quality", "guess", ["lang"]).select("lang", F.lit("before").alias("stage"), "accuracy")
    after = metrics.accuracy(rows, "quality", "pred", ["lang"]).select("lang", F.lit("after").alias("stage"), "accuracy")
    return rounded(runs.before_after(before.unionByName(after), "lang", "stage", "accuracy"))


@query("attempts_to_success", """
    WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events)
    SELECT user_id, min(attempt) FILTER (event_type = 'purchase' AND attempt <= 5) AS succeeded_at,
           least(count(*), 5) AS tried FROM a GROUP BY user_id""")
def attempts_to_success(spark, folder):
    events = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type")
    return runs.attempts_to_success(events, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", 5)
