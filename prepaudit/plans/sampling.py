"""Splits, samples and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepaudit.operators import sample, weights
from prepaudit.operators.neighbours import nearest
from prepaudit.plans.inputs import (LABELLED_SQL, SEED, digest_sql, fine_uniform_sql, gaussian_sql, labelled, rounded, split_sql, table,
                                    uniform_sql)
from prepaudit.plans.registry import query


def _orders(spark, folder):
    return table(spark, folder, "orders", "o_orderkey", "o_orderstatus")


@query("split_hash", f"SELECT o_orderkey, o_orderstatus, {split_sql('o_orderkey')} AS split FROM orders")
def split_hash(spark, folder):
    return sample.hash_split(_orders(spark, folder), "o_orderkey", 0.8, SEED)


@query("split_stratified", f"""
    SELECT o_orderkey, o_orderstatus, CASE WHEN
        row_number() OVER (PARTITION BY o_orderstatus ORDER BY {digest_sql('o_orderkey')}, o_orderkey)
        <= ceil(0.7::DOUBLE * count(*) OVER (PARTITION BY o_orderstatus)) THEN 'train' ELSE 'test' END AS split
    FROM orders""")
def split_stratified(spark, folder):
    return sample.stratified_split(_orders(spark, folder), "o_orderkey", "o_orderstatus", 0.7, SEED)


@query("kfold_stratified", f"""
    SELECT o_orderkey, o_orderstatus, (ntile(5) OVER (PARTITION BY o_orderstatus
        ORDER BY {digest_sql('o_orderkey')}, o_orderkey) - 1)::INT AS fold FROM orders""")
def kfold_stratified(spark, folder):
    return sample.stratified_folds(_orders(spark, folder), "o_orderkey", "o_orderstatus", 5, SEED)


@query("sample_by_class", f"""
    WITH {LABELLED_SQL} SELECT doc_id, quality FROM labelled
    WHERE quality <> 1 OR substr({digest_sql('doc_id')}, 1, 8) < '99999999'""")
def sample_by_class(spark, folder):
    return sample.sample_by_class(labelled(spark, folder), "doc_id", "quality", {1: 0.6}, SEED).select("doc_id", "quality")


@query("undersample", f"""
    WITH {LABELLED_SQL}, r AS (SELECT doc_id, quality,
        row_number() OVER (PARTITION BY quality ORDER BY {digest_sql('doc_id')}, doc_id) AS rn FROM labelled)
    SELECT doc_id, quality FROM r
    WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labelled GROUP BY quality))""")
def undersample(spark, folder):
    return sample.undersample(labelled(spark, folder), "doc_id", "quality", SEED).select("doc_id", "quality")


@query("bootstrap_weighted", f"""
    WITH {LABELLED_SQL}, laid AS (
        SELECT doc_id, quality, sum(n_chars) OVER (PARTITION BY quality ORDER BY doc_id)::BIGINT AS upto, n_chars AS w,
               sum(n_chars) OVER (PARTITION BY quality)::BIGINT AS length FROM labelled),
    darts AS (SELECT quality, {fine_uniform_sql('doc_id')} * length::DOUBLE AS at FROM laid)
    SELECT doc_id, l.quality, row_number() OVER (PARTITION BY doc_id) AS copy
    FROM laid l JOIN darts d ON l.quality = d.quality AND d.at >= l.upto - l.w AND d.at < l.upto""")
def bootstrap_weighted(spark, folder):
    rows = sample.bootstrap(labelled(spark, folder), "doc_id", "n_chars", ["quality"], SEED)
    return rows.select("doc_id", "quality", "copy")


# The train rows drawn again with importance weights, which are seldom whole numbers.
@query("bootstrap_importance", f"""
    WITH {LABELLED_SQL}, s AS (SELECT *, {split_sql('doc_id')} AS split FROM labelled),
    f AS (SELECT lang, count(*)::DOUBLE / (SELECT count(*) FROM s) AS a,
                 count(*) FILTER (split = 'train')::DOUBLE / (SELECT count(*) FROM s WHERE split = 'train') AS t
          FROM s GROUP BY lang),
    w AS (SELECT doc_id, lang, (a / t)::DECIMAL(26, 12) AS w FROM s JOIN f USING (lang) WHERE split = 'train'),
    laid AS (SELECT doc_id, lang, w, sum(w) OVER (ORDER BY doc_id) AS upto, sum(w) OVER () AS length FROM w),
    darts AS (SELECT {fine_uniform_sql('doc_id')} * length::DOUBLE AS at FROM laid)
    SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id) AS copy
    FROM laid l JOIN darts d ON d.at >= (l.upto - l.w)::DOUBLE AND d.at < l.upto::DOUBLE""")
def bootstrap_importance(spark, folder):
    rows = sample.hash_split(labelled(spark, folder), "doc_id", seed=SEED)
    weighed = weights.importance_weights(rows, "lang", F.col("split") == "train")
    return sample.bootstrap(weighed, "doc_id", "weight", seed=SEED).select("doc_id", "lang", "copy")


@query("noise_inject", f"""
    SELECT c_custkey, round(c_acctbal + 15.0::DOUBLE * {gaussian_sql('c_custkey', f'{SEED}/c_acctbal')}, 6) AS c_acctbal
    FROM customer""")
def noise_inject(spark, folder):
    customers = table(spark, folder, "customer", "c_custkey", "c_acctbal")
    return rounded(sample.add_noise(customers, "c_custkey", ["c_acctbal"], 15.0, SEED))


# The class with the fewest vectors, each vector's five nearest in the class.
NEAR_SQL = """sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
    small AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings
              WHERE label = (SELECT label FROM sizes ORDER BY n, label LIMIT 1)),
    dist AS (SELECT a.vec_id, b.vec_id AS neighbour, round(sqrt(list_sum(list_transform(list_zip(a.e, b.e),
                    lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS distance
             FROM small a JOIN small b ON a.vec_id <> b.vec_id),
    near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM dist)"""


@query("smote_knn", f"WITH {NEAR_SQL} SELECT vec_id, rank::INT AS rank, neighbour, distance FROM near WHERE rank <= 5")
def smote_knn(spark, folder):
    vectors = table(spark, folder, "embeddings")
    sizes = vectors.groupBy("label").agg(F.count("*").alias("n"))
    smallest = sizes.agg(F.min(F.struct("n", "label")).alias("s")).select("s.label").scalar()
    return nearest(vectors.filter(F.col("label") == smallest), "vec_id", "embedding", 5)


@query("smote", f"""
    WITH {NEAR_SQL}, need AS (SELECT max(n) - min(n) AS need, min(n) AS have FROM sizes),
    quota AS (SELECT vec_id, e, label, need // have + (row_number() OVER (ORDER BY {digest_sql('vec_id')}, vec_id)
                     <= need % have)::INT AS q FROM small, need),
    copies AS (SELECT vec_id, e, label, unnest(range(1, q + 1)) AS copy FROM quota),
    lists AS (SELECT vec_id, list(neighbour ORDER BY rank) AS near FROM near WHERE rank <= 5 GROUP BY vec_id),
    made AS (SELECT c.vec_id, c.copy, c.label, c.e, {uniform_sql('c.vec_id, c.copy', f'{SEED}/u')} AS u,
                    near[1 + ('0x' || substr({digest_sql('c.vec_id, c.copy', f'{SEED}/n')}, 1, 8))::BIGINT % len(near)]
                        AS neighbour
             FROM copies c JOIN lists l ON c.vec_id = l.vec_id),
    points AS (SELECT m.vec_id, m.copy, m.neighbour, m.label, m.e, s.e AS f, u, unnest(range(len(m.e))) AS i
               FROM made m JOIN small s ON m.neighbour = s.vec_id)
    SELECT vec_id, copy, neighbour, label, i::INT AS pos, round(e[i + 1] + u * (f[i + 1] - e[i + 1]), 6) AS value
    FROM points""")
def smote(spark, folder):
    made = sample.smote(table(spark, folder, "embeddings"), "vec_id", "embedding", "label", 5, SEED)
    cells = F.posexplode("embedding").alias("pos", "value")
    return rounded(made.select("vec_id", "copy", "neighbour", "label", cells))
