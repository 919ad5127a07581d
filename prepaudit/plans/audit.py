"""Profiles, metrics, fairness, weights and feature relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepaudit.functions.rows import stacked
from prepaudit.operators import fairness, metrics, profile, relevance, sample, weights
from prepaudit.operators.distributed import scalars
from prepaudit.plans.inputs import (FOLDED_SQL, GAPS_SQL, LABELLED_SQL, SCORED_SQL, SEED, digest_sql, folded, gaps,
                                    gaussian_sql, labelled, rounded, scored, split_sql, table)
from prepaudit.plans.registry import query


def train():
    return F.col("split") == "train"


@query("value_shares", """
    SELECT lang, count(*) AS n, round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS share
    FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def value_shares(spark, folder):
    return profile.value_shares(table(spark, folder, "documents", "lang"), "lang")


@query("group_counts", f"WITH {GAPS_SQL} SELECT priority, count(*) AS n FROM gaps GROUP BY priority")
def group_counts(spark, folder):
    return profile.group_counts(gaps(spark, folder), "priority")


@query("null_profile", f"""
    WITH {GAPS_SQL}, c AS (SELECT split, count(*) FILTER (total IS NULL) AS total,
        count(*) FILTER (priority IS NULL) AS priority, count(*) FILTER (status IS NULL) AS status
        FROM gaps GROUP BY split)
    SELECT split, feature, nulls, nulls > 0 AS any_null
    FROM (UNPIVOT c ON total, priority, status INTO NAME feature VALUE nulls)""")
def null_profile(spark, folder):
    return profile.null_profile(gaps(spark, folder), ["total", "priority", "status"], ["split"])


def _describe_sql(column: str) -> str:
    return f"""SELECT split, '{column}' AS feature, count({column}) AS count, round(avg({column}), 4) AS mean,
        round(stddev_samp({column}), 4) AS std, round(min({column})::DOUBLE, 4) AS min,
        round(quantile_cont({column}, 0.25)::DOUBLE, 4) AS q25, round(quantile_cont({column}, 0.5)::DOUBLE, 4) AS q50,
        round(quantile_cont({column}, 0.75)::DOUBLE, 4) AS q75, round(max({column})::DOUBLE, 4) AS max
        FROM o GROUP BY split"""


@query("describe_by_split", f"""
    WITH o AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, o_custkey::DOUBLE AS o_custkey,
                      {split_sql('o_orderkey')} AS split FROM orders)
    {_describe_sql('o_totalprice')} UNION ALL {_describe_sql('o_custkey')}""")
def describe_by_split(spark, folder):
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    orders = orders.withColumn("o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    split = sample.hash_split(orders, "o_orderkey", seed=SEED)
    return rounded(profile.describe_by(split, ["o_totalprice", "o_custkey"], ["split"]), 4)


@query("table_info", f"""
    WITH {GAPS_SQL} SELECT 'total' AS feature, 'double' AS type, count(total) AS non_null FROM gaps
    UNION ALL SELECT 'priority', 'string', count(priority) FROM gaps
    UNION ALL SELECT 'split', 'string', count(split) FROM gaps""")
def table_info(spark, folder):
    return profile.info(gaps(spark, folder).select("total", "priority", "split"))


@query("table_shape", "SELECT count(*) AS rows, 11 AS columns FROM lineitem")
def table_shape(spark, folder):
    return profile.shape(table(spark, folder, "lineitem"))


@query("imbalance_flag", """
    WITH s AS (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM labels GROUP BY quality)
    SELECT count(*) AS classes, round(min(share), 6) AS min_share, min(share) < 0.2 AS imbalanced FROM s""")
def imbalance_flag(spark, folder):
    return rounded(profile.imbalance(table(spark, folder, "labels", "quality"), "quality", 0.2))


@query("share_drift", f"""
    WITH {SCORED_SQL}, b AS (SELECT lang, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM scored
                             WHERE split = 'train' GROUP BY lang),
    a AS (SELECT lang, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM scored WHERE split = 'test' GROUP BY lang)
    SELECT lang, round(coalesce(b.s, 0), 6) AS share_before, round(coalesce(a.s, 0), 6) AS share_after,
           round(coalesce(a.s, 0) - coalesce(b.s, 0), 6) AS drift FROM b FULL JOIN a USING (lang)""")
def share_drift(spark, folder):
    return rounded(profile.share_drift(scored(spark, folder), "lang", "split", "train", "test"))


@query("accuracy", f"""
    WITH {SCORED_SQL} SELECT split, round(avg((quality = pred)::INT), 6) AS accuracy, count(*) AS n
    FROM scored GROUP BY split""")
def accuracy(spark, folder):
    return rounded(metrics.accuracy(scored(spark, folder), "quality", "pred", ["split"]))


def _report_sql(rows: str, by: str = "") -> str:
    """Report over a relation with text columns y and p, per ``by`` when given."""
    also = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
    cells AS (SELECT {also}y AS label, 1.0::DOUBLE AS actual, 0.0::DOUBLE AS predicted, (y = p)::INT::DOUBLE AS hits
              FROM {rows} UNION ALL SELECT {also}p, 0, 1, 0 FROM {rows}),
    classes AS (SELECT {also}label, sum(actual) AS actual,
                       coalesce(sum(hits) / nullif(sum(predicted), 0), 0) AS precision,
                       coalesce(sum(hits) / nullif(sum(actual), 0), 0) AS recall,
                       coalesce(2 * sum(hits) / nullif(sum(predicted) + sum(actual), 0), 0) AS f1_score,
                       sum(hits) AS hits
                FROM cells GROUP BY {also}label),
    report AS (SELECT {also}label, precision, recall, f1_score, actual FROM classes
        UNION ALL SELECT {also}'accuracy', NULL, NULL, coalesce(sum(hits) / nullif(sum(actual), 0), 0), sum(actual)
        FROM classes {group}
        UNION ALL SELECT {also}'macro avg', avg(precision), avg(recall), avg(f1_score), sum(actual) FROM classes {group}
        UNION ALL SELECT {also}'weighted avg', sum(precision * actual) / sum(actual), sum(recall * actual) / sum(actual),
        sum(f1_score * actual) / sum(actual), sum(actual) FROM classes {group})"""


def _report_select(by: str = "") -> str:
    also = f"{by}, " if by else ""
    return (f"SELECT {also}label, round(precision, 6) AS precision, round(recall, 6) AS recall, "
            "round(f1_score, 6) AS f1_score, actual::BIGINT AS support FROM report")


TEST_SQL = "judged AS (SELECT lang, quality::VARCHAR AS y, pred::VARCHAR AS p FROM scored WHERE split = 'test')"


@query("classification_report", f"WITH {SCORED_SQL}, {TEST_SQL}, {_report_sql('judged')} {_report_select()}")
def classification_report(spark, folder):
    return rounded(metrics.classification_report(scored(spark, folder).filter(~train()), "quality", "pred"))


@query("slice_report", f"WITH {SCORED_SQL}, {TEST_SQL}, {_report_sql('judged', 'lang')} {_report_select('lang')}")
def slice_report(spark, folder):
    return rounded(metrics.classification_report(scored(spark, folder).filter(~train()), "quality", "pred", ["lang"]))


@query("slice_report_two_keys", f"""
    WITH {SCORED_SQL}, judged AS (SELECT concat(lang, '/', source) AS slice, quality::VARCHAR AS y, pred::VARCHAR AS p
                                  FROM scored),
    {_report_sql('judged', 'slice')}, cut AS ({_report_select('slice')})
    SELECT split_part(slice, '/', 1) AS lang, slice[strpos(slice, '/') + 1:] AS source, label, precision, recall,
           f1_score, support FROM cut""")
def slice_report_two_keys(spark, folder):
    return rounded(metrics.classification_report(scored(spark, folder), "quality", "pred", ["lang", "source"]))


@query("confusion_matrix", f"""
    WITH {SCORED_SQL}, c AS (SELECT unnest([0, 1]) AS v)
    SELECT a.v AS actual, b.v AS predicted,
           (SELECT count(*) FROM scored WHERE quality = a.v AND pred = b.v) AS n FROM c a, c b""")
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(scored(spark, folder), "quality", "pred", [0, 1])


@query("roc_auc", f"""
    WITH {LABELLED_SQL}, ranked AS (SELECT quality, rank() OVER (ORDER BY n_chars)
        + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS r FROM labelled),
    s AS (SELECT sum(r) FILTER (quality = 1) AS rs, count(*) FILTER (quality = 1) AS p,
                 count(*) FILTER (quality = 0) AS q FROM ranked)
    SELECT round((rs - p * (p + 1) / 2.0::DOUBLE) / (p * q), 6) AS auc, p AS positives, q AS negatives FROM s""")
def roc_auc(spark, folder):
    return rounded(metrics.roc_auc(labelled(spark, folder), "quality", "n_chars"))


PRICES_SQL = """priced AS (SELECT l_linestatus, l_extendedprice / 1000 AS y,
        l_quantity * (SELECT avg(l_extendedprice / 1000) / avg(l_quantity) FROM lineitem) AS p FROM lineitem)"""


@query("regression_metrics", f"""
    WITH {PRICES_SQL} SELECT l_linestatus, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2,
        round(avg(abs(y - p)), 6) AS mae, round(avg((y - p) * (y - p)), 6) AS mse,
        round(sqrt(avg((y - p) * (y - p))), 6) AS rmse FROM priced GROUP BY l_linestatus""")
def regression_metrics(spark, folder):
    items = table(spark, folder, "lineitem", "l_linestatus", "l_quantity", "l_extendedprice")
    price = F.col("l_extendedprice") / F.lit(1000.0)
    unit = scalars(items.agg((F.avg(price) / F.avg("l_quantity")).alias("u")))["u"]
    rows = items.select("l_linestatus", price.alias("y"), (F.col("l_quantity") * unit).alias("p"))
    return rounded(metrics.regression_metrics(rows, "y", "p", ["l_linestatus"]))


@query("group_accuracy", f"""
    WITH {SCORED_SQL} SELECT source, round(avg((quality = pred)::INT), 6) AS accuracy, count(*) AS n
    FROM scored WHERE source IS NOT NULL GROUP BY source""")
def group_accuracy(spark, folder):
    return rounded(metrics.group_accuracy(scored(spark, folder), "quality", "pred", "source"))


@query("fairness_metrics", f"""
    WITH {SCORED_SQL}, r AS (SELECT
        avg(pred) FILTER (lang <> 'en') AS su, avg(pred) FILTER (lang = 'en') AS sv,
        avg(pred) FILTER (lang <> 'en' AND quality = 1) AS tu, avg(pred) FILTER (lang = 'en' AND quality = 1) AS tv,
        avg(pred) FILTER (lang <> 'en' AND quality = 0) AS fu, avg(pred) FILTER (lang = 'en' AND quality = 0) AS fv
        FROM scored)
    SELECT round(su / nullif(sv, 0), 6) AS disparate_impact, round(0.5 * ((fu - fv) + (tu - tv)), 6)
        AS average_odds_difference, round(tu - tv, 6) AS equal_opportunity_difference FROM r""")
def fairness_metrics(spark, folder):
    return rounded(fairness.fairness_metrics(scored(spark, folder), "quality", "pred", "lang", "en", ["fr", "de", "es"]))


@query("shift_check", f"""
    WITH {SCORED_SQL}, m AS (SELECT avg(pred) FILTER (split = 'train') AS a, avg(pred) FILTER (split <> 'train') AS b
                             FROM scored)
    SELECT round(a, 6) AS train_mean, round(b, 6) AS test_mean, round(abs(a - b), 6) AS gap, abs(a - b) > 0.1 AS shifted
    FROM m""")
def shift_check(spark, folder):
    return rounded(metrics.shift_check(scored(spark, folder), "pred", train()))


@query("shift_check_kernel")
def shift_check_kernel(spark, folder):
    return rounded(metrics.shift_check_kernel(scored(spark, folder), ["n_chars", "toxic"], "quality", train()))


@query("noise_robustness", f"""
    WITH {SCORED_SQL}, noisy AS (SELECT quality, pred, (n_chars + 300.0::DOUBLE
        * {gaussian_sql('doc_id', f'{SEED}/n_chars')} >= (SELECT avg(n_chars) FROM scored WHERE split = 'train'))::INT
        AS noisy FROM scored WHERE split = 'test'),
    a AS (SELECT avg((quality = pred)::INT) AS c, avg((quality = noisy)::INT) AS n FROM noisy)
    SELECT round(c, 6) AS accuracy_clean, round(n, 6) AS accuracy_noisy, round(c - n, 6) AS loss FROM a""")
def noise_robustness(spark, folder):
    rows = scored(spark, folder)
    mean = scalars(rows.filter(train()).agg(F.avg("n_chars").alias("m")))["m"]
    noisy = sample.add_noise(rows.filter(~train()), "doc_id", ["n_chars"], 300.0, SEED, "_noisy")
    judged = noisy.withColumn("noisy", (F.col("n_chars_noisy") >= mean).cast("int"))
    return rounded(metrics.noise_robustness(judged, "quality", "pred", "noisy"))


@query("cv_summary", f"""
    WITH {FOLDED_SQL}, s AS (SELECT fold, avg((quality = pred)::INT) AS accuracy FROM folded GROUP BY fold)
    SELECT round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std,
           round(2 * stddev_pop(accuracy), 6) AS two_std FROM s""")
def cv_summary(spark, folder):
    scores = metrics.accuracy(folded(spark, folder), "quality", "pred", ["fold"])
    return rounded(metrics.cv_summary(scores, "accuracy"))


@query("cv_multimetric", f"""
    WITH {FOLDED_SQL}, ranked AS (SELECT fold, quality, pred, rank() OVER (PARTITION BY fold ORDER BY n_chars)
        + (count(*) OVER (PARTITION BY fold, n_chars) - 1) / 2.0::DOUBLE AS r FROM folded),
    s AS (SELECT fold, avg((quality = pred)::INT) AS accuracy, sum(quality * pred)::DOUBLE AS tp,
                 sum(pred)::DOUBLE AS said, sum(quality)::DOUBLE AS yes, sum(r) FILTER (quality = 1) AS rs,
                 count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS q FROM ranked GROUP BY fold)
    SELECT fold, round(accuracy, 6) AS accuracy, round(coalesce(tp / nullif(said, 0), 0), 6) AS precision,
           round(coalesce(tp / nullif(yes, 0), 0), 6) AS recall,
           round(coalesce(2 * tp / nullif(said + yes, 0), 0), 6) AS f1_score,
           round((rs - p * (p + 1) / 2.0::DOUBLE) / nullif(p * q, 0), 6) AS auc FROM s""")
def cv_multimetric(spark, folder):
    return rounded(metrics.fold_metrics(folded(spark, folder), "quality", "pred", "n_chars", "fold"))


@query("reweighing", f"""
    WITH {LABELLED_SQL} SELECT doc_id, lang, quality, round(count(*) OVER (PARTITION BY lang)::DOUBLE
        * count(*) OVER (PARTITION BY quality) / (count(*) OVER () * count(*) OVER (PARTITION BY lang, quality)), 6)
        AS weight FROM labelled""")
def reweighing(spark, folder):
    return rounded(weights.reweighing(labelled(spark, folder).select("doc_id", "lang", "quality"), "lang", "quality"))


@query("class_weights", f"""
    WITH {LABELLED_SQL} SELECT doc_id, quality, round(count(*) OVER ()::DOUBLE
        / ((SELECT count(DISTINCT quality) FROM labelled) * count(*) OVER (PARTITION BY quality)), 6) AS weight
    FROM labelled""")
def class_weights(spark, folder):
    return rounded(weights.class_weights(labelled(spark, folder).select("doc_id", "quality"), "quality"))


@query("share_weights", f"""
    WITH {LABELLED_SQL} SELECT doc_id, quality,
        round(count(*) OVER (PARTITION BY quality)::DOUBLE / count(*) OVER (), 6) AS weight FROM labelled""")
def share_weights(spark, folder):
    return rounded(weights.share_weights(labelled(spark, folder).select("doc_id", "quality"), "quality"))


@query("importance_weights", f"""
    WITH {LABELLED_SQL}, s AS (SELECT *, {split_sql('doc_id')} AS split FROM labelled),
    w AS (SELECT doc_id, quality, split, count(*) OVER (PARTITION BY quality)::DOUBLE / count(*) OVER () AS a,
                 count(*) FILTER (split = 'train') OVER (PARTITION BY quality)::DOUBLE
                     / count(*) FILTER (split = 'train') OVER () AS t FROM s)
    SELECT doc_id, quality, round(a / t, 6) AS weight FROM w WHERE split = 'train'""")
def importance_weights(spark, folder):
    rows = sample.hash_split(labelled(spark, folder).select("doc_id", "quality"), "doc_id", seed=SEED)
    return rounded(weights.importance_weights(rows, "quality", train()).drop("split"))


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ANOVA_SQL = """long AS (SELECT l_returnflag AS y, feature, value FROM (
        UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM items)
        ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value)),
    c AS (SELECT feature, y, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) AS v FROM long GROUP BY feature, y),
    g AS (SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS grand FROM c),
    f AS (SELECT feature, (sum(n * (m - grand) * (m - grand)) / (count(*) - 1))
                 / (sum(n * v) / (sum(n) - count(*))) AS f_score FROM g GROUP BY feature)"""


@query("select_kbest", f"""
    WITH items AS (SELECT * FROM lineitem WHERE {split_sql('l_orderkey')} = 'train'), {ANOVA_SQL}
    SELECT feature, round(f_score, 6) AS f_score FROM f ORDER BY f_score DESC, feature LIMIT 2""")
def select_kbest(spark, folder):
    items = table(spark, folder, "lineitem", "l_orderkey", "l_returnflag", *FEATURES)
    split = sample.hash_split(items, "l_orderkey", seed=SEED)
    return rounded(relevance.select_k_best(split, FEATURES, "l_returnflag", 2, train()))


# The features chosen on the train rows, the others taken out of the test rows: long, as columns depend on the choice.
@query("select_kbest_apply", f"""
    WITH items AS (SELECT * FROM lineitem WHERE {split_sql('l_orderkey')} = 'train'), {ANOVA_SQL},
    best AS (SELECT feature FROM f ORDER BY f_score DESC, feature LIMIT 2),
    cells AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value FROM lineitem WHERE {split_sql('l_orderkey')} = 'test'" for c in FEATURES)})
    SELECT feature, count(*) AS n, round(sum(value), 4) AS total FROM cells JOIN best USING (feature) GROUP BY feature""")
def select_kbest_apply(spark, folder):
    items = table(spark, folder, "lineitem", "l_orderkey", "l_returnflag", *FEATURES)
    split = sample.hash_split(items, "l_orderkey", seed=SEED)
    chosen = relevance.select_k_best(split, FEATURES, "l_returnflag", 2, train())
    reduced = relevance.keep_selected(split.filter(~train()), FEATURES, chosen)
    kept = [c for c in reduced.columns if c in FEATURES]
    sums = reduced.agg(*[x for c in kept for x in (F.count(c).alias(f"n_{c}"), F.sum(F.col(c).cast("double")).alias(f"t_{c}"))])
    rows = stacked(*[{"feature": c, "n": F.col(f"n_{c}"), "total": F.round(f"t_{c}", 4)} for c in kept])
    return sums.select(F.inline(rows))


@query("feature_topk", f"""
    WITH items AS (SELECT * FROM lineitem), {ANOVA_SQL}
    SELECT feature, round(f_score, 6) AS f_score FROM f ORDER BY f_score DESC, feature LIMIT 3""")
def feature_topk(spark, folder):
    scores = relevance.anova_f(table(spark, folder, "lineitem", "l_returnflag", *FEATURES), FEATURES, "l_returnflag")
    return rounded(relevance.top_features(scores, "f_score", 3))


@query("corr_matrix", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]) + ")")
def corr_matrix(spark, folder):
    return rounded(relevance.correlation_matrix(table(spark, folder, "lineitem", *FEATURES), FEATURES))


PROTECTED = ["en", "es", "fr"]
OTHERS = {"n_chars": "n_chars", "accented": "(lang <> 'en')::INT", "quality": "quality", "toxic": "toxic"}


@query("proxy_attributes", f"WITH {LABELLED_SQL}, c AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS feature, abs(corr((lang = '{p}')::INT, {expr})) AS c FROM labelled"
    for p in PROTECTED for name, expr in OTHERS.items()) + """)
    SELECT feature, round(max(c), 6) AS strongest, max(c) > 0.8 AS proxy FROM c GROUP BY feature""")
def proxy_attributes(spark, folder):
    rows = labelled(spark, folder).withColumn("accented", (F.col("lang") != "en").cast("int"))
    rows = rows.withColumns({f"lang_{p}": (F.col("lang") == p).cast("int") for p in PROTECTED})
    return rounded(relevance.proxies(rows, [f"lang_{p}" for p in PROTECTED], list(OTHERS), 0.8))


@query("permutation_importance", f"""
    WITH {LABELLED_SQL}, m AS (SELECT avg(n_chars) AS m FROM labelled),
    runs AS (SELECT l.*, run, {digest_sql('doc_id, run')} AS h FROM labelled l, (SELECT unnest(range(1, 11)) AS run)),
    moved AS (SELECT *, coalesce(lead(n_chars) OVER w, first(n_chars) OVER a) AS other_chars,
                     coalesce(lead(toxic) OVER w, first(toxic) OVER a) AS other_toxic FROM runs
              WINDOW w AS (PARTITION BY run ORDER BY h, doc_id), a AS (PARTITION BY run ORDER BY h, doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    hits AS (SELECT (quality = (n_chars >= m AND toxic = 0)::INT)::INT AS own,
                    (quality = (other_chars >= m AND toxic = 0)::INT)::INT AS a,
                    (quality = (n_chars >= m AND other_toxic = 0)::INT)::INT AS b FROM moved, m)
    SELECT 'n_chars' AS feature, round(avg(own - a), 6) AS importance FROM hits
    UNION ALL SELECT 'toxic', round(avg(own - b), 6) FROM hits""")
def permutation_importance(spark, folder):
    rows = labelled(spark, folder)
    mean = scalars(rows.agg(F.avg("n_chars").alias("m")))["m"]

    def rule(given):
        return ((given["n_chars"] >= mean) & (given["toxic"] == 0)).cast("int")
    return rounded(relevance.permutation_importance(rows, "doc_id", "quality", ["n_chars", "toxic"], rule, 10, SEED))
