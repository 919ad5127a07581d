"""Cleaning, imputation, encoding and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepaudit.operators import clean, encode, impute, profile, sample, scale
from prepaudit.plans.inputs import GAPS_SQL, gaps, rounded, split_sql, strip_sql, table
from prepaudit.plans.registry import query


def train():
    return F.col("split") == "train"


@query("placeholder_nulls", """
    SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
           nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders""")
def placeholder_nulls(spark, folder):
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return clean.placeholders_to_null(orders, ["?", "P", "4-NOT SPECIFIED"])


@query("filter_conjunction", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_discount FROM lineitem
    WHERE l_quantity BETWEEN 5 AND 30 AND l_returnflag <> 'N' AND l_discount <= 0.07::DOUBLE""")
def filter_conjunction(spark, folder):
    items = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_discount")
    return clean.keep_rows(items, F.col("l_quantity").between(5, 30), clean.differs(F.col("l_returnflag"), "N"),
                           F.col("l_discount") <= 0.07)


@query("filter_after_split", f"""
    WITH {GAPS_SQL} SELECT o_orderkey, split, status, total, priority FROM gaps
    WHERE total >= 100000 AND priority IS DISTINCT FROM '5-LOW'""")
def filter_after_split(spark, folder):
    """The label stays in the row, so features and labels cannot come apart."""
    kept = clean.keep_rows(gaps(spark, folder), F.col("total") >= 100000, clean.differs(F.col("priority"), "5-LOW"))
    return kept.select("o_orderkey", "split", "status", "total", "priority")


@query("recode_values", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS target_one,
           o_orderstatus AS other_one, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS target_all,
           CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS other_all FROM orders""")
def recode_values(spark, folder):
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderstatus")
    status = F.col("o_orderstatus")
    one = clean.recode(orders.select("o_orderkey", status.alias("target_one"), status.alias("other_one"), status),
                       "P", "O", ["target_one"])
    every = one.withColumns({"target_all": status, "other_all": status}).drop("o_orderstatus")
    return clean.recode(every, "P", "O", ["target_all", "other_all"])


@query("recode_frame", """
    SELECT o_orderkey, replace(o_orderstatus, 'P', 'O') AS target, replace(o_orderstatus, 'P', 'O') AS other
    FROM orders""")
def recode_frame(spark, folder):
    """Without named columns the replacement reaches the whole frame."""
    status = F.col("o_orderstatus")
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderstatus")
    return clean.recode(orders.select("o_orderkey", status.alias("target"), status.alias("other")), "P", "O")


@query("text_normalize", f"""
    SELECT doc_id, replace(lower({strip_sql('text')}), '-', ' ') AS text FROM documents""")
def text_normalize(spark, folder):
    return table(spark, folder, "documents", "doc_id", "text").withColumn("text", clean.normalise_text(F.col("text")))


def _customers(spark, folder):
    customers = table(spark, folder, "customer", "c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation", "n_nationkey", "n_name", "n_regionkey")
    regions = table(spark, folder, "region", "r_regionkey", "r_name")
    return (customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name"))


@query("granularity_loss", """
    WITH c AS (SELECT n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey
               JOIN region ON n_regionkey = r_regionkey),
    cells AS (SELECT 'region' AS rollup, 'before' AS side, n_name AS v FROM c UNION ALL
              SELECT 'region', 'after', r_name FROM c UNION ALL
              SELECT 'constant', 'before', n_name FROM c UNION ALL SELECT 'constant', 'after', 'All' FROM c),
    counts AS (SELECT rollup, side, v, count(*)::DOUBLE AS n FROM cells GROUP BY ALL),
    shares AS (SELECT rollup, side, n / sum(n) OVER (PARTITION BY rollup, side) AS p FROM counts)
    SELECT rollup, side, count(*) AS distinct_values, round(sum(-p * ln(p)), 6) AS entropy
    FROM shares GROUP BY rollup, side""")
def granularity_loss(spark, folder):
    customers = _customers(spark, folder)
    flat = customers.withColumn("r_name", F.lit("All"))
    parts = [profile.granularity(c, "n_name", "r_name").select(F.lit(name).alias("rollup"), "*")
             for name, c in (("region", customers), ("constant", flat))]
    return rounded(parts[0].unionByName(parts[1])).withColumn("entropy", F.col("entropy") + F.lit(0.0))


@query("category_rollup", """
    SELECT c_custkey, n_name, CASE WHEN n_name IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3')
        THEN 'NORTH' ELSE n_name END AS rolled
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def category_rollup(spark, folder):
    members = ["NATION_0", "NATION_1", "NATION_2", "NATION_3"]
    rolled = clean.collapse(F.col("n_name"), members, "NORTH")
    return _customers(spark, folder).select("c_custkey", "n_name", rolled.alias("rolled"))


@query("anonymize_generalize", """
    WITH g AS (SELECT
        CASE WHEN count(*) OVER (PARTITION BY source) >= 50 THEN source ELSE 'anon' END AS source,
        CASE WHEN count(*) OVER (PARTITION BY lang) >= 110 THEN lang ELSE 'anon' END AS lang FROM documents)
    SELECT source, lang, count(*) AS n FROM g GROUP BY source, lang""")
def anonymize_generalize(spark, folder):
    documents = table(spark, folder, "documents", "source", "lang")
    hidden = clean.generalise(clean.generalise(documents, ["source"], 50), ["lang"], 110)
    return clean.group_sizes(hidden, ["source", "lang"])


@query("dropna_any", f"""
    WITH {GAPS_SQL} SELECT o_orderkey, total, priority FROM gaps WHERE total IS NOT NULL AND priority IS NOT NULL""")
def dropna_any(spark, folder):
    return clean.drop_null_rows(gaps(spark, folder).select("o_orderkey", "total", "priority"))


@query("dropna_subset", f"WITH {GAPS_SQL} SELECT o_orderkey, total, priority FROM gaps WHERE priority IS NOT NULL")
def dropna_subset(spark, folder):
    return clean.drop_null_rows(gaps(spark, folder).select("o_orderkey", "total", "priority"), ["priority"])


@query("label_map", """
    SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS building,
           CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 END AS code,
           (c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY'))::INT AS mapped FROM customer""")
def label_map(spark, folder):
    segment = F.col("c_mktsegment")
    code = clean.map_values(segment, {"AUTOMOBILE": 0, "BUILDING": 1, "MACHINERY": 2})
    return table(spark, folder, "customer", "c_custkey", "c_mktsegment").select(
        "c_custkey", clean.indicator(segment, "BUILDING").alias("building"), code.alias("code"),
        clean.present(code).alias("mapped"))


@query("fixed_bins", """
    SELECT c_custkey, CASE WHEN c_acctbal >= 0 AND c_acctbal < 2500 THEN 'low'
        WHEN c_acctbal >= 2500 AND c_acctbal < 5000 THEN 'mid' WHEN c_acctbal >= 5000 AND c_acctbal < 9000 THEN 'high'
        END AS band FROM customer""")
def fixed_bins(spark, folder):
    band = clean.fixed_bins(F.col("c_acctbal"), [0, 2500, 5000, 9000], ["low", "mid", "high"])
    return table(spark, folder, "customer", "c_custkey", "c_acctbal").select("c_custkey", band.alias("band"))


@query("duration_days", """
    SELECT l_orderkey, l_linenumber,
           floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE) AS days
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def duration_days(spark, folder):
    items = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderdate")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    return clean.DurationDays(startCol="o_orderdate", endCol="l_shipdate", outputCol="days").transform(joined)


@query("token_extract", """
    SELECT page_id, CASE WHEN contains(url, '://') THEN split_part(split_part(url, '://', 2), '/', 1) END AS host
    FROM pages""")
def token_extract(spark, folder):
    pages = table(spark, folder, "pages", "page_id", "url")
    return pages.select("page_id", clean.token_between(F.col("url"), "://", "/").alias("host"))


@query("rare_bucket", """
    SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand) >= 80 THEN p_brand ELSE 'Rare' END AS p_brand,
           CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN p_type ELSE 'Rare' END AS kind FROM part""")
def rare_bucket(spark, folder):
    parts = table(spark, folder, "part", "p_partkey", "p_brand", "p_type")
    kept = clean.keep_frequent(parts, "p_brand", 80)
    return kept.select("p_partkey", "p_brand", clean.keep_listed(F.col("p_type"), ["ECONOMY", "LARGE"]).alias("kind"))


MODE_SQL = """(SELECT priority FROM gaps WHERE priority IS NOT NULL {0} GROUP BY priority
    ORDER BY count(*) DESC, priority LIMIT 1)"""


@query("impute_mean", f"""
    WITH {GAPS_SQL} SELECT o_orderkey, round(coalesce(total,
        (SELECT avg(total) FROM gaps WHERE split = 'train')), 4) AS total FROM gaps""")
def impute_mean(spark, folder):
    filled = impute.impute(gaps(spark, folder), {"total": "mean"}, train())
    return rounded(filled.select("o_orderkey", "total"), 4)


@query("impute_median", f"""
    WITH {GAPS_SQL} SELECT o_orderkey, round(coalesce(total,
        (SELECT median(total) FROM gaps WHERE split = 'train')), 4) AS total FROM gaps""")
def impute_median(spark, folder):
    filled = impute.impute(gaps(spark, folder), {"total": "median"}, train())
    return rounded(filled.select("o_orderkey", "total"), 4)


@query("impute_mode", f"""
    WITH {GAPS_SQL} SELECT o_orderkey, coalesce(priority, {MODE_SQL.format("AND split = 'train'")}) AS priority
    FROM gaps""")
def impute_mode(spark, folder):
    return impute.impute(gaps(spark, folder), {"priority": "mode"}, train()).select("o_orderkey", "priority")


@query("impute_constant", f"""
    WITH {GAPS_SQL} SELECT o_orderkey, coalesce(total, 0.0) AS total, coalesce(priority, 'missing') AS priority
    FROM gaps""")
def impute_constant(spark, folder):
    fills = {"total": ("constant", 0.0), "priority": ("constant", "missing")}
    return impute.impute(gaps(spark, folder), fills).select("o_orderkey", "total", "priority")


@query("impute_by_type", f"""
    WITH {GAPS_SQL} SELECT o_orderkey, round(coalesce(total, (SELECT avg(total) FROM gaps)), 4) AS total,
        coalesce(priority, {MODE_SQL.format("")}) AS priority, status FROM gaps""")
def impute_by_type(spark, folder):
    df = gaps(spark, folder).select("o_orderkey", "total", "priority", "status")
    return rounded(impute.impute(df, impute.by_type(df, ["total", "priority", "status"])), 4)


@query("impute_train_only", f"""
    WITH {GAPS_SQL} SELECT o_orderkey, split,
        round(coalesce(total, (SELECT median(total) FROM gaps WHERE split = 'train')), 4) AS total,
        coalesce(priority, {MODE_SQL.format("AND split = 'train'")}) AS priority FROM gaps""")
def impute_train_only(spark, folder):
    filled = impute.impute(gaps(spark, folder), {"total": "median", "priority": "mode"}, train())
    return rounded(filled.select("o_orderkey", "split", "total", "priority"), 4)


@query("impute_regression")
def impute_regression(spark, folder):
    items = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax")
    holes = items.withColumns({"l_quantity": F.when(F.col("l_tax") > 0, F.col("l_quantity")),
                               "l_extendedprice": F.when(F.col("l_tax") < 0.08, F.col("l_extendedprice"))})
    return impute.impute_regression(holes, ["l_quantity", "l_extendedprice", "l_tax"])


@query("label_encode", """
    SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part""")
def label_encode(spark, folder):
    parts = table(spark, folder, "part", "p_partkey", "p_brand")
    return encode.label_encode(parts, "p_brand", encode.label_codes(parts, "p_brand"), "code")


@query("one_hot_sparse", """
    WITH codes AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS code
                   FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus <> 'P'))
    SELECT o_orderkey, code AS place FROM orders LEFT JOIN codes USING (o_custkey)""")
def one_hot_sparse(spark, folder):
    """As many columns as customers, written out as (row, place of the 1)."""
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    codes = encode.label_codes(orders.filter(F.col("o_orderstatus") != "P"), "o_custkey")
    return encode.one_hot_sparse(orders, "o_custkey", codes, "place").select("o_orderkey", "place")


@query("ordinal_encode", """
    WITH codes AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code
                   FROM (SELECT DISTINCT p_name FROM part WHERE p_size <= 3))
    SELECT p_partkey, p.p_name, coalesce(code, -1) AS code FROM part p LEFT JOIN codes c ON p.p_name = c.p_name""")
def ordinal_encode(spark, folder):
    parts = table(spark, folder, "part", "p_partkey", "p_name", "p_size")
    codes = encode.label_codes(parts.filter(F.col("p_size") <= 3), "p_name")
    return encode.ordinal_encode(parts, "p_name", codes, "code").drop("p_size")


def _indicators(column: str, values: list[str]) -> str:
    return ", ".join(f"({column} = '{v}')::INT AS {encode.indicator_name(column, v)}" for v in values)


@query("onehot_ignore", f"""
    SELECT p_partkey, {_indicators('p_type', ['ECONOMY', 'LARGE', 'MEDIUM', 'SMALL', 'STANDARD'])} FROM part""")
def onehot_ignore(spark, folder):
    """PROMO does not occur in the fitted rows and becomes all zeros."""
    parts = table(spark, folder, "part", "p_partkey", "p_type")
    known = encode.categories(parts.filter(F.col("p_type") != "PROMO"), "p_type")
    return encode.one_hot(parts, "p_type", known)


@query("onehot_drop_first", f"""
    SELECT c_custkey, {_indicators('c_mktsegment', ['BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])}
    FROM customer""")
def onehot_drop_first(spark, folder):
    customers = table(spark, folder, "customer", "c_custkey", "c_mktsegment")
    return encode.one_hot(customers, "c_mktsegment", encode.categories(customers, "c_mktsegment"), drop_first=True)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("dummies_align", f"""
    SELECT o_orderkey, {_indicators('o_orderpriority', PRIORITIES[1:])}, {split_sql('o_orderkey')} AS split
    FROM orders WHERE NOT ({split_sql('o_orderkey')} = 'test' AND o_orderpriority = '2-HIGH')""")
def dummies_align(spark, folder):
    """The test rows lack one category; aligning gives them its column back, as zeros."""
    orders = sample.hash_split(table(spark, folder, "orders", "o_orderkey", "o_orderpriority"), "o_orderkey")
    fitted = encode.dummies(orders.filter(train()), ["o_orderpriority"], drop_first=True)
    rest = orders.filter(~train() & (F.col("o_orderpriority") != "2-HIGH"))
    return fitted.unionByName(encode.align_columns(encode.dummies(rest, ["o_orderpriority"]), fitted.columns))


@query("binarize_label", "SELECT o_orderkey, (o_orderstatus = 'O')::INT AS y FROM orders")
def binarize_label(spark, folder):
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderstatus")
    return orders.select("o_orderkey", encode.binarise(F.col("o_orderstatus"), ["F", "O"]).alias("y"))


PARTS_SQL = f"parts AS (SELECT p_partkey, p_retailprice, {split_sql('p_partkey')} AS split FROM part)"


def _parts(spark, folder):
    return sample.hash_split(table(spark, folder, "part", "p_partkey", "p_retailprice"), "p_partkey")


@query("bins_uniform", f"""
    WITH {PARTS_SQL}, e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM parts WHERE split = 'train')
    SELECT p_partkey, greatest(0, least(3, floor((p_retailprice - lo) / (hi - lo) * 4.0::DOUBLE)::INT)) AS bin
    FROM parts, e""")
def bins_uniform(spark, folder):
    return encode.uniform_bins(_parts(spark, folder), "p_retailprice", 4, "bin", train()).select("p_partkey", "bin")


@query("bins_quantile", f"""
    WITH {PARTS_SQL}, e AS (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS q
                            FROM parts WHERE split = 'train')
    SELECT p_partkey, (p_retailprice >= q[1])::INT + (p_retailprice >= q[2])::INT + (p_retailprice >= q[3])::INT AS bin
    FROM parts, e""")
def bins_quantile(spark, folder):
    return encode.quantile_bins(_parts(spark, folder), "p_retailprice", 4, "bin", train()).select("p_partkey", "bin")


@query("featurize_spec", f"""
    WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal,
                      nullif(c_mktsegment, 'MACHINERY') AS segment, {split_sql('c_custkey')} AS split FROM customer),
    f AS (SELECT c_custkey, split,
                 coalesce(bal, (SELECT median(bal) FROM c WHERE split = 'train')) AS bal,
                 coalesce(segment, (SELECT segment FROM c WHERE split = 'train' AND segment IS NOT NULL
                     GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)) AS segment FROM c)
    SELECT c_custkey, round((bal - (SELECT avg(bal) FROM f WHERE split = 'train'))
               / (SELECT stddev_pop(bal) FROM f WHERE split = 'train'), 6) AS bal,
           {_indicators('segment', ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD'])} FROM f""")
def featurize_spec(spark, folder):
    customers = table(spark, folder, "customer", "c_custkey", "c_acctbal", "c_mktsegment").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"),
        F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"))
    spec = encode.Features(numeric=["bal"], categorical=["segment"], fill_numeric="median", keep=["c_custkey"])
    return rounded(encode.featurise(sample.hash_split(customers, "c_custkey"), spec, train()))


ITEMS_SQL = f"""items AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
                                 {split_sql('l_orderkey')} AS split FROM lineitem)"""


def _scaled(spark, folder, method):
    items = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    items = sample.hash_split(items, "l_orderkey")
    return rounded(scale.scale(items, ["l_quantity", "l_extendedprice"], method, train()).drop("split"))


def _scaled_sql(centre: str, width: str) -> str:
    fits = ", ".join(f"{centre.format(c)} AS {c}_c, {width.format(c)} AS {c}_w"
                     for c in ("l_quantity", "l_extendedprice"))
    cells = ", ".join(f"round(({c} - {c}_c) / {c}_w, 6) AS {c}" for c in ("l_quantity", "l_extendedprice"))
    return (f"WITH {ITEMS_SQL}, fit AS (SELECT {fits} FROM items WHERE split = 'train') "
            f"SELECT l_orderkey, l_linenumber, {cells} FROM items, fit")


@query("scale_standard", _scaled_sql("avg({0})", "stddev_pop({0})"))
def scale_standard(spark, folder):
    return _scaled(spark, folder, "standard")


@query("scale_robust", _scaled_sql("median({0})", "(quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25))"))
def scale_robust(spark, folder):
    return _scaled(spark, folder, "robust")


@query("scale_minmax", _scaled_sql("min({0})", "(max({0}) - min({0}))"))
def scale_minmax(spark, folder):
    return _scaled(spark, folder, "minmax")


@query("normalize_rows", """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v)
    SELECT vec_id, i::INT AS pos, round(e[i + 1] / norm, 6) AS value
    FROM (SELECT vec_id, e, norm, unnest(range(len(e))) AS i FROM n)""")
def normalize_rows(spark, folder):
    vectors = table(spark, folder, "embeddings", "vec_id", "embedding")
    cells = F.posexplode(scale.normalise_vector(F.col("embedding"))).alias("pos", "value")
    return rounded(vectors.select("vec_id", cells))


@query("normalize_columns", """
    SELECT l_orderkey, l_linenumber,
           round(l_discount / CASE WHEN s = 0 THEN 1 ELSE sqrt(s) END, 6) AS l_discount,
           round(l_tax / CASE WHEN s = 0 THEN 1 ELSE sqrt(s) END, 6) AS l_tax
    FROM (SELECT *, l_discount * l_discount + l_tax * l_tax AS s FROM lineitem)""")
def normalize_columns(spark, folder):
    items = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return rounded(scale.normalise_rows(items, ["l_discount", "l_tax"]))
