"""Comparison of paired texts and scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepaudit.functions import code, text
from prepaudit.operators import cases, nearpairs, pairs, runs
from prepaudit.plans.inputs import (LEFT_SCRIPT, PAIRS_SQL, RUNS_SQL, SCRIPTS_SQL, WHITE_SQL, document_pairs, event_runs, lines_sql,
                                    rounded, script_pairs, strip_sql, table, words_sql)
from prepaudit.plans.registry import query


def _turns(spark, folder):
    return table(spark, folder, "conversations").withColumnRenamed("conv_id", "case")


@query("case_complete", """
    SELECT conv_id AS "case", min_by(text, turn) FILTER (role = 'system') AS system,
           min_by(text, turn) FILTER (role = 'user') AS "user",
           min_by(text, turn) FILTER (role = 'assistant') AS assistant
    FROM conversations GROUP BY conv_id HAVING count(DISTINCT role) = 3""")
def case_complete(spark, folder):
    return cases.complete_cases(_turns(spark, folder), ["system", "user", "assistant"], order="turn")


def _uncommented_sql(column: str) -> str:
    return f"array_to_string(list_filter({lines_sql(column)}, lambda l: NOT regexp_matches(l, '^{WHITE_SQL}*#')), chr(10))"


@query("case_pending", f"""
    SELECT conv_id AS "case", turn, {_uncommented_sql('text')} AS text FROM conversations c
    WHERE role = 'user' AND NOT EXISTS
        (SELECT 1 FROM conversations a WHERE a.conv_id = c.conv_id AND a.role = 'system')""")
def case_pending(spark, folder):
    turns = _turns(spark, folder)
    asked = turns.filter(F.col("role") == "user").select("case", "turn", "text")
    return cases.pending_cases(asked, turns.filter(F.col("role") == "system"))


COMMENTED = "replace(text, concat(chr(10), 'T'), concat(chr(10), '  # T'))"


@query("strip_comment_lines", f"""
    WITH d AS (SELECT doc_id, {COMMENTED} AS text FROM documents)
    SELECT doc_id, {_uncommented_sql('text')} AS text FROM d""")
def strip_comment_lines(spark, folder):
    documents = table(spark, folder, "documents", "doc_id", "text")
    return documents.select("doc_id", text.strip_comment_lines(F.expr(COMMENTED)).alias("text"))


def _dice_sql(pieces, output: str) -> str:
    """``pieces`` turns a text column into an SQL list."""
    return f"""
    l AS (SELECT "case", piece, count(*) AS n FROM (SELECT "case", unnest({pieces('"left"')}) AS piece FROM pairs)
          GROUP BY ALL),
    r AS (SELECT "case", piece, count(*) AS n FROM (SELECT "case", unnest({pieces('"right"')}) AS piece FROM pairs)
          GROUP BY ALL),
    shared AS (SELECT "case", sum(least(l.n, r.n)) AS m FROM l JOIN r USING ("case", piece) GROUP BY "case"),
    total AS (SELECT "case", sum(n) AS t FROM (SELECT * FROM l UNION ALL SELECT * FROM r) GROUP BY "case"),
    scores AS (SELECT pairs."case", CASE WHEN t IS NULL THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(m, 0) / t END
                      AS {output} FROM pairs LEFT JOIN total USING ("case") LEFT JOIN shared USING ("case"))"""


def _grams_sql(n: int):
    def pieces(column: str) -> str:
        if n == 1:
            return f"string_split({column}, '')"
        return f"list_transform(range(1, len({column}) - {n - 2}), lambda i: substr({column}, i, {n}))"
    return pieces


@query("pair_line_similarity", f"""
    WITH {PAIRS_SQL}, {_dice_sql(lines_sql, 'line_similarity')} SELECT "case", round(line_similarity, 6) AS line_similarity FROM scores""")
def pair_line_similarity(spark, folder):
    return rounded(pairs.line_similarity(document_pairs(spark, folder)))


@query("pair_char_similarity", f"""
    WITH {PAIRS_SQL}, {_dice_sql(_grams_sql(1), 'char_similarity')}
    SELECT "case", round(char_similarity, 6) AS char_similarity FROM scores""")
def pair_char_similarity(spark, folder):
    return rounded(pairs.char_similarity(document_pairs(spark, folder), 1))


@query("pair_ngram_similarity", f"""
    WITH {PAIRS_SQL}, {_dice_sql(_grams_sql(3), 'char_similarity')}
    SELECT "case", round(char_similarity, 6) AS char_similarity FROM scores""")
def pair_ngram_similarity(spark, folder):
    return rounded(pairs.char_similarity(document_pairs(spark, folder), 3))


@query("near_pairs_lsh")
def near_pairs_lsh(spark, folder):
    """Documents that are near copies, with their class's least document and the Dice coefficient of 5-grams with it."""
    return rounded(nearpairs.near_classes(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text"))


def _size_sql(column: str, side: str) -> str:
    return (f"len({lines_sql(column)})::INT AS lines_{side}, len({words_sql(column)})::INT AS words_{side}, "
            f"len(regexp_extract_all({column}, '[.!?]+'))::INT AS sentences_{side}")


@query("pair_structure_diff", f"""
    WITH {PAIRS_SQL}, s AS (SELECT "case", {_size_sql('"left"', 'left')}, {_size_sql('"right"', 'right')} FROM pairs),
    t AS (SELECT "case", """ + ", ".join(
    f"CASE WHEN words_{s} > 0 THEN {p}_{s} ELSE -1 END AS {p}_{s}"
    for p in ("lines", "words", "sentences") for s in ("left", "right")) + """ FROM s)
    SELECT *, lines_right - lines_left AS lines_diff, words_right - words_left AS words_diff,
           sentences_right - sentences_left AS sentences_diff FROM t""")
def pair_structure_diff(spark, folder):
    return pairs.structure_diff(document_pairs(spark, folder))


@query("pair_changed_lines", f"""
    WITH {PAIRS_SQL}, l AS (SELECT "case", piece, count(*) AS n FROM
        (SELECT "case", unnest({lines_sql('"left"')}) AS piece FROM pairs) GROUP BY ALL),
    r AS (SELECT "case", piece, count(*) AS n FROM
        (SELECT "case", unnest({lines_sql('"right"')}) AS piece FROM pairs) GROUP BY ALL),
    c AS (SELECT "case", piece, coalesce(r.n, 0) - coalesce(l.n, 0) AS d FROM l FULL JOIN r USING ("case", piece)),
    s AS (SELECT "case", sum(greatest(d, 0))::BIGINT AS added, sum(greatest(-d, 0))::BIGINT AS removed,
                 coalesce(sum(abs(d)) FILTER (starts_with(piece, ' ')), 0)::BIGINT AS indented_changed
          FROM c GROUP BY "case")
    SELECT "case", coalesce(added, 0) AS added, coalesce(removed, 0) AS removed,
           coalesce(indented_changed, 0) AS indented_changed, coalesce(added + removed, 0) AS changed
    FROM pairs LEFT JOIN s USING ("case")""")
def pair_changed_lines(spark, folder):
    return pairs.changed_lines(document_pairs(spark, folder))


# Extracted lists in SQL, over a text column; patterns are those of functions/code.py.
def _listed_sql(names: str) -> str:
    bare = f"string_split(regexp_replace({names}, '[()]', '', 'g'), ',')"
    named = rf"list_transform({bare}, lambda n: regexp_replace({strip_sql('n')}, '(?s)\s+as\s.*$', ''))"
    return f"list_filter({named}, lambda n: n <> '')"


def _imports_sql(column: str) -> str:
    hits = [f"regexp_extract_all({column}, '{code.IMPORT_LINE}', {g})" for g in (1, 2, 3)]
    return f"""flatten(list_transform(list_zip({', '.join(hits)}), lambda h: CASE WHEN h[1] <> ''
        THEN list_transform({_listed_sql('h[2]')}, lambda x: concat(h[1], '.', x)) ELSE {_listed_sql('h[3]')} END))"""


def _components_sql(column: str) -> str:
    hits = [f"regexp_extract_all({column}, '{code.SKLEARN_IMPORT}', {g})" for g in (1, 2)]
    return f"""flatten(list_transform(list_zip({', '.join(hits)}), lambda h: list_transform(list_filter(list_transform(
        string_split(h[2], ','), lambda n: {strip_sql('n')}), lambda n: n <> ''), lambda x: concat(h[1], '.', x))))"""


def _tags_sql(column: str) -> str:
    found = ", ".join("CASE WHEN " + " AND ".join(f"contains({column}, '{p}')" for p in parts) + f" THEN '{tag}' END"
                      for tag, parts in code.PREPROCESSING_RULES)
    return f"list_filter([{found}], lambda t: t IS NOT NULL)"


def _seed_sql(column: str) -> str:
    arguments = f"regexp_extract({column}, '{code.FOREST_CALL}', 1)"
    return (f"CASE WHEN contains({arguments}, 'random_state') "
            f"THEN coalesce(nullif(regexp_extract({arguments}, '{code.SEED}', 1), ''), 'True') END")


LISTS_SQL = f"""{SCRIPTS_SQL}, lists AS (SELECT "case",
    {_imports_sql('"left"')} AS li, {_imports_sql('"right"')} AS ri,
    {_components_sql('"left"')} AS lc, {_components_sql('"right"')} AS rc,
    {_tags_sql('"left"')} AS lt, {_tags_sql('"right"')} AS rt,
    {_seed_sql('"left"')} AS ls, {_seed_sql('"right"')} AS rs FROM scripts)"""


def _less_sql(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


def joined(column, separator=","):
    return F.array_join(column, separator)


@query("extract_pattern_arrays", f"""
    WITH {LISTS_SQL} SELECT "case", array_to_string(li, ',') AS imports_left, array_to_string(ri, ',') AS imports_right,
        array_to_string(lc, ',') AS components_left, array_to_string(rc, ',') AS components_right FROM lists""")
def extract_pattern_arrays(spark, folder):
    left, right = F.col("left"), F.col("right")
    return script_pairs(spark, folder).select(
        "case", joined(code.imports(left)).alias("imports_left"), joined(code.imports(right)).alias("imports_right"),
        joined(code.sklearn_components(left)).alias("components_left"),
        joined(code.sklearn_components(right)).alias("components_right"))


@query("rule_tags", f"""
    WITH {LISTS_SQL} SELECT "case", array_to_string(lt, ',') AS tags_left, array_to_string(rt, ',') AS tags_right
    FROM lists""")
def rule_tags(spark, folder):
    return script_pairs(spark, folder).select(
        "case", joined(code.preprocessing_steps(F.col("left"))).alias("tags_left"),
        joined(code.preprocessing_steps(F.col("right"))).alias("tags_right"))


@query("extract_kv", f'WITH {LISTS_SQL} SELECT "case", ls AS seed_left, rs AS seed_right FROM lists')
def extract_kv(spark, folder):
    found = pairs.components(script_pairs(spark, folder))
    return found.select("case", *[F.try_element_at(F.col(f"model_params.{s}"), F.lit("random_state")).alias(f"seed_{s}")
                                  for s in ("left", "right")])


@query("set_diff_arrays", f"""
    WITH {LISTS_SQL} SELECT "case", array_to_string({_less_sql('li', 'ri')}, ',') AS missing_imports,
        array_to_string({_less_sql('ri', 'li')}, ',') AS extra_imports,
        array_to_string({_less_sql('lt', 'rt')}, ',') AS missing_tags,
        array_to_string({_less_sql('rt', 'lt')}, ',') AS extra_tags FROM lists""")
def set_diff_arrays(spark, folder):
    found = pairs.extracted(script_pairs(spark, folder))
    cells = {}
    for kind, name in (("imports", "imports"), ("preprocessing", "tags")):
        left, right = F.col(f"{kind}_left"), F.col(f"{kind}_right")
        cells[f"missing_{name}"] = text.not_in(left, right)
        cells[f"extra_{name}"] = text.not_in(right, left)
    return found.select("case", *[joined(c).alias(n) for n, c in cells.items()])


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


ISSUES_SQL = "list_filter([CASE WHEN list_contains(lc, 'preprocessing.StandardScaler') AND list_contains(rc, " \
    f"'preprocessing.Normalizer') THEN {_quoted(code.ISSUE_SCALER)} END, " + ", ".join(
        f"CASE WHEN list_contains(rt, '{tag}') AND NOT list_contains(lt, '{tag}') THEN {_quoted(message)} END"
        for tag, message in code.ISSUE_TAGS) + \
    f", CASE WHEN ls IS NOT NULL AND rs IS NULL THEN {_quoted(code.ISSUE_SEED)} END], lambda x: x IS NOT NULL)"


@query("issue_rules", f"""
    WITH {LISTS_SQL}, i AS (SELECT "case", {ISSUES_SQL} AS issues FROM lists)
    SELECT "case", (p - 1)::INT AS number, issues[p] AS issue
    FROM (SELECT "case", issues, unnest(range(1, len(issues) + 1)) AS p FROM i)""")
def issue_rules(spark, folder):
    found = pairs.issues(script_pairs(spark, folder))
    # outer, then filtered: an inner explode would infer a filter that reads every script a second time
    return found.select("case", F.posexplode_outer("issues").alias("number", "issue")).filter(F.col("issue").isNotNull())


DIFF_SQL = f"""{RUNS_SQL}, diff AS (SELECT "case",
    coalesce(max(execution_time) FILTER (role = 'generated'), 0) - coalesce(max(execution_time) FILTER (role = 'correct'), 0)
        AS execution_time_diff,
    coalesce(max(memory_used_mb) FILTER (role = 'generated'), 0) - coalesce(max(memory_used_mb) FILTER (role = 'correct'), 0)
        AS memory_used_mb_diff,
    coalesce(bool_or(success) FILTER (role = 'correct'), false) AS success_correct,
    coalesce(bool_or(success) FILTER (role = 'generated'), false) AS success_generated
    FROM runs GROUP BY "case")"""
PIECES_SQL = SCRIPTS_SQL.replace("scripts AS", "pairs AS")
REPORT_SQL = f"""WITH {PIECES_SQL}, {LISTS_SQL.replace(SCRIPTS_SQL, 'scripts AS (SELECT * FROM pairs)')},
    {DIFF_SQL}, {_dice_sql(lines_sql, 'line_similarity').replace(' scores AS', ' line_scores AS')},
    cl AS (SELECT "case", piece, count(*) AS n FROM (SELECT "case", unnest(string_split("left", '')) AS piece FROM pairs) GROUP BY ALL),
    cr AS (SELECT "case", piece, count(*) AS n FROM (SELECT "case", unnest(string_split("right", '')) AS piece FROM pairs) GROUP BY ALL),
    cm AS (SELECT "case", sum(least(cl.n, cr.n)) AS m FROM cl JOIN cr USING ("case", piece) GROUP BY "case"),
    general AS (SELECT pairs."case", line_similarity, 2.0::DOUBLE * m / (len("left") + len("right")) AS char_similarity,
        len({words_sql('"right"')})::INT - len({words_sql('"left"')})::INT AS structure_diff, {ISSUES_SQL} AS found,
        success_correct, success_generated, execution_time_diff, memory_used_mb_diff
        FROM pairs JOIN line_scores USING ("case") JOIN cm USING ("case") JOIN lists USING ("case")
        LEFT JOIN diff USING ("case"))"""


@query("pair_report", f"""{REPORT_SQL}
    SELECT "case", round(line_similarity, 6) AS line_similarity, round(char_similarity, 6) AS char_similarity,
        structure_diff, len(found)::INT AS issue_count, array_to_string(found, '; ') AS issues,
        round(execution_time_diff, 6) AS execution_time_diff, round(memory_used_mb_diff, 6) AS memory_used_mb_diff,
        success_correct, success_generated FROM general""")
def pair_report(spark, folder):
    compared = runs.run_differences(event_runs(spark, folder)).select(
        "case", "execution_time_diff", "memory_used_mb_diff", "success_correct", "success_generated")
    return rounded(pairs.report_general(script_pairs(spark, folder), compared))


@query("pair_report_components", f"""
    WITH {LISTS_SQL} SELECT "case", """ + ", ".join(
    f"array_to_string({_less_sql(*pair)}, chr(10)) AS {side}_{kind}"
    for kind, a, b in (("imports", "li", "ri"), ("sklearn_components", "lc", "rc"), ("preprocessing", "lt", "rt"))
    for side, pair in (("extra", (b, a)), ("missing", (a, b)))) + " FROM lists")
def pair_report_components(spark, folder):
    return pairs.report_components(script_pairs(spark, folder))


@query("overall_score", f"""{REPORT_SQL},
    parts AS (SELECT "case", 0.7::DOUBLE * char_similarity + 0.3::DOUBLE * line_similarity AS similarity_score,
        greatest(0.0::DOUBLE, least(2.0::DOUBLE, (o_custkey / 100.0::DOUBLE) / (o_totalprice / 100000.0::DOUBLE))) AS ratio,
        o_orderstatus <> 'P' AS has_base,
        greatest(0.0::DOUBLE, 1.0::DOUBLE - len(found) * 0.2::DOUBLE) AS ml_correctness_score,
        CASE WHEN success_correct IS NULL THEN 1.0 WHEN success_correct AND success_generated THEN 1.0
             WHEN success_correct THEN 0.0 WHEN success_generated THEN 1.5 ELSE 0.5 END::DOUBLE AS execution_score
        FROM general JOIN orders ON o_orderkey = "case"),
    weighed AS (SELECT *, CASE WHEN has_base THEN ratio ELSE 1.0::DOUBLE END AS quality_ratio, (0.25::DOUBLE * similarity_score
        + 0.20::DOUBLE * CASE WHEN has_base THEN ratio ELSE 1.0::DOUBLE END + 0.30::DOUBLE * ml_correctness_score
        + 0.25::DOUBLE * execution_score) * 10.0::DOUBLE AS overall_score FROM parts)
    SELECT "case", round(similarity_score, 6) AS similarity_score, round(quality_ratio, 6) AS quality_ratio,
        round(ml_correctness_score, 6) AS ml_correctness_score, round(execution_score, 6) AS execution_score,
        round(overall_score, 6) AS overall_score, CASE WHEN overall_score >= 8.5 THEN 'Excellent'
            WHEN overall_score >= 7.0 THEN 'Good' WHEN overall_score >= 5.0 THEN 'Acceptable'
            WHEN overall_score >= 3.0 THEN 'Poor' ELSE 'Unacceptable' END AS verdict FROM weighed""")
def overall_score(spark, folder):
    """Linter scores are given columns; here an order's price stands for them, and 0 for status P."""
    compared = runs.run_differences(event_runs(spark, folder)).select("case", "success_correct", "success_generated")
    report = pairs.report_general(script_pairs(spark, folder), compared)
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).otherwise(F.lit(0.0))
    given = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").select(
        F.col("o_orderkey").alias("case"), (price / F.lit(100000.0)).alias("lint_left"),
        (F.col("o_custkey") / F.lit(100.0)).alias("lint_right"))
    scored = pairs.assess(report.join(given, "case"), F.col("lint_left"), F.col("lint_right"),
                          F.col("success_correct"), F.col("success_generated"))
    return rounded(scored.select("case", "similarity_score", "quality_ratio", "ml_correctness_score",
                                 "execution_score", "overall_score", "verdict"))


TEMPLATE = "Issue: ##NAME##\nOriginal:\n##CODE##\nFixed:\n##FIXED##\nSay whether the issue is fixed."


@query("template_tokens", f"""
    WITH {SCRIPTS_SQL}, p AS (SELECT "case", concat('Issue: ', "case", chr(10), 'Original:', chr(10), "left", chr(10),
        'Fixed:', chr(10), "right", chr(10), 'Say whether the issue is fixed.') AS prompt FROM scripts)
    SELECT "case", prompt, floor(len({words_sql('prompt')}) * 1.5)::BIGINT AS tokens FROM p""")
def template_tokens(spark, folder):
    values = {"##NAME##": F.col("case").cast("string"), "##CODE##": F.col("left"), "##FIXED##": F.col("right")}
    filled = script_pairs(spark, folder).select("case", text.fill_template(TEMPLATE, values).alias("prompt"))
    return filled.withColumn("tokens", text.token_estimate(F.col("prompt")))


REPLY = f"""CASE WHEN o_orderstatus = 'O' THEN concat('No block here.', chr(10), o_orderpriority)
    ELSE concat('Corrected:', chr(10), '```python', chr(10), {LEFT_SCRIPT}, chr(10), '```', chr(10), 'and',
                chr(10), '```python', chr(10), 'x = 1', chr(10), '```') END"""


@query("extract_block", f"""
    WITH r AS (SELECT o_orderkey, {REPLY} AS reply FROM orders)
    SELECT o_orderkey, nullif(regexp_extract(reply, '(?s)```python\\n(.+?)```', 1), '') AS block,
           replace(replace(reply, '```python', ''), '```', '') AS bare FROM r""")
def extract_block(spark, folder):
    reply = F.expr(REPLY)
    return table(spark, folder, "orders").select("o_orderkey", text.fenced_block(reply).alias("block"),
                                                 text.strip_fences(reply).alias("bare"))


PROBLEMS = """concat(concat_ws(chr(10), concat('Scaling ', o_orderstatus, ': use a: fitted scaler'),
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'Split: by time' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'a line without the mark' ELSE concat('  Imputation : ', o_custkey) END), chr(10), ' ', chr(10))"""


@query("line_titles", f"""
    WITH p AS (SELECT o_orderkey, {PROBLEMS} AS t FROM orders),
    l AS (SELECT o_orderkey, string_split({strip_sql('t')}, chr(10)) AS rows FROM p)
    SELECT o_orderkey, CASE WHEN len(list_filter(rows, lambda x: NOT contains(x, ':'))) > 0 THEN ''
        ELSE array_to_string(list_transform(rows, lambda x: {strip_sql("split_part(x, ':', 1)")}), ',') END AS titles
    FROM l""")
def line_titles(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", joined(text.line_titles(F.expr(PROBLEMS))).alias("titles"))
