"""Inputs that several queries share, as frames and as SQL.

The given tables hold neither nulls nor scripts, so both are derived from
their values: an unspecified priority becomes null, and an order decides what a
script contains. Text that a query only consumes is written once as an SQL
expression and used by both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prepaudit.operators import sample
from prepaudit.operators.distributed import attach, scalars, settle
from prepaudit.sources.tables import parquet

SEED = 42
#: Script pairs of a task: reading a script costs far more than its row in a scan.
SCRIPTS_AT_ONCE = 1 << 16


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = parquet(spark, folder, name)
    return df.select(*columns) if columns else df


def wide_table(spark: SparkSession, folder: str, name: str, *columns: str, most_rows: int | None = None) -> DataFrame:
    """For work that multiplies rows or parses text: one small file, whose scan is fewer tasks than cores, is dealt out to them.

    With ``most_rows``, so is a table whose scan has fewer tasks than it takes for each to have about that many rows.
    """
    df, cores = table(spark, folder, name, *columns), spark.sparkContext.defaultParallelism
    wanted = max(min(cores, 64), -(-df.count() // most_rows) if most_rows else 0)
    return df.repartition(max(cores, wanted)) if df.rdd.getNumPartitions() < wanted else df


def digest_sql(key: str, seed=SEED) -> str:
    return f"md5(concat_ws(':', {key}, '{seed}'))"


def uniform_sql(key: str, seed=SEED) -> str:
    return f"(('0x' || substr({digest_sql(key, seed)}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def fine_uniform_sql(key: str, seed=SEED) -> str:
    return f"(('0x' || substr({digest_sql(key, seed)}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def gaussian_sql(key: str, seed=SEED) -> str:
    return (f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {uniform_sql(key, f'{seed}/r')}))"
            f" * cos(6.283185307179586::DOUBLE * {uniform_sql(key, f'{seed}/a')}))")


def split_sql(key: str) -> str:
    return f"CASE WHEN substr({digest_sql(key)}, 1, 8) < 'cccccccc' THEN 'train' ELSE 'test' END"


def rounded(df: DataFrame, digits: int = 6, **only: int) -> DataFrame:
    """Round every double column, so that two engines agree on sums taken in another order."""
    return df.select(*[F.round(c, only.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Orders with gaps: total is unknown for status P, priority where it says so.
GAPS_SQL = f"""gaps AS (
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS total,
           nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, o_orderstatus AS status,
           {split_sql('o_orderkey')} AS split
    FROM orders)"""


def gaps(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    df = orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("total"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"), F.col("o_orderstatus").alias("status"))
    return sample.hash_split(df, "o_orderkey", seed=SEED)


# Documents that carry labels.
LABELLED_SQL = """labelled AS (
    SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, folder, "labels"), "doc_id").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic")


# The same with a stratified split and a rule as model: long documents are good ones.
SCORED_SQL = f"""{LABELLED_SQL}, placed AS (
    SELECT *, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {digest_sql('doc_id')}, doc_id)
                        <= ceil(0.8::DOUBLE * count(*) OVER (PARTITION BY quality)) THEN 'train' ELSE 'test' END AS split
    FROM labelled), scored AS (
    SELECT *, (n_chars >= (SELECT avg(n_chars) FROM placed WHERE split = 'train'))::INT AS pred FROM placed)"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    rows = settle(labelled(spark, folder))  # read by the split, the fit and the query: join once
    split = sample.stratified_split(rows, "doc_id", "quality", 0.8, SEED)
    mean = scalars(split.filter(F.col("split") == "train").agg(F.avg("n_chars").alias("m")))["m"]
    return split.withColumn("pred", (F.col("n_chars") >= mean).cast("int"))


# Folds over the labelled documents, with the prediction fitted on the other folds.
FOLDED_SQL = f"""{LABELLED_SQL}, folds AS (
    SELECT *, (ntile(5) OVER (PARTITION BY quality ORDER BY {digest_sql('doc_id')}, doc_id) - 1)::INT AS fold
    FROM labelled), sums AS (
    SELECT fold, sum(n_chars)::DOUBLE AS s, count(*)::DOUBLE AS n FROM folds GROUP BY fold), means AS (
    SELECT fold, ((SELECT sum(s) FROM sums) - s) / ((SELECT sum(n) FROM sums) - n) AS m FROM sums), folded AS (
    SELECT f.*, (f.n_chars >= m.m)::INT AS pred FROM folds f JOIN means m ON f.fold = m.fold)"""


def folded(spark: SparkSession, folder: str) -> DataFrame:
    folds = sample.stratified_folds(settle(labelled(spark, folder)), "doc_id", "quality", 5, SEED)
    sums = folds.groupBy("fold").agg(F.sum("n_chars").cast("double").alias("s"), F.count("*").cast("double").alias("n"))
    every = Window.partitionBy()
    others = (F.sum("s").over(every) - F.col("s")) / (F.sum("n").over(every) - F.col("n"))
    return attach(folds, sums.select("fold", others.alias("m")), "fold").withColumn(
        "pred", (F.col("n_chars") >= F.col("m")).cast("int")).drop("m")


# Pairs of texts: every document against an edited version of itself.
EDIT = ("CASE WHEN lang = 'en' THEN replace(text, ' the ', ' a ') "
        "ELSE replace(text, '. ', concat('.', chr(10), ' ')) END")
PAIRS_SQL = f'pairs AS (SELECT doc_id AS "case", text AS "left", {EDIT} AS "right" FROM documents)'


def document_pairs(spark: SparkSession, folder: str) -> DataFrame:
    documents = wide_table(spark, folder, "documents", "doc_id", "lang", "text")
    return documents.select(F.col("doc_id").alias("case"), F.col("text").alias("left"), F.expr(EDIT).alias("right"))


# Pairs of scripts: what an order decides, in two versions.
LEFT_SCRIPT = """concat_ws(chr(10),
    'import pandas as pd', 'import numpy, os.path',
    CASE WHEN o_orderstatus = 'F' THEN 'from sklearn.preprocessing import StandardScaler, OneHotEncoder  # scale'
         ELSE 'from sklearn.preprocessing import MinMaxScaler' END,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'x = x.str.lower()' ELSE 'x = x.str.strip()' END,
    concat('clf = RandomForestClassifier(n_estimators=10',
           CASE WHEN o_orderstatus <> 'P' THEN concat(', random_state=', o_custkey) ELSE '' END, ')'))"""
RIGHT_SCRIPT = """concat_ws(chr(10),
    'import pandas', 'from os import path as p, sep',
    CASE WHEN o_orderpriority < '3' THEN 'from sklearn.preprocessing import Normalizer, OneHotEncoder'
         ELSE 'from sklearn.impute import SimpleImputer' END,
    CASE WHEN o_orderpriority = '2-HIGH' THEN 'x = x.str.lower().str.replace(a, b)' ELSE 'x = x.str.strip()' END,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'data[native-country] = data.apply(lambda x: 1)' ELSE '# nothing' END,
    concat('clf = RandomForestClassifier(',
           CASE WHEN o_orderpriority >= '3' THEN 'random_state=seed' ELSE '' END, ')'))"""
SCRIPTS_SQL = f'scripts AS (SELECT o_orderkey AS "case", {LEFT_SCRIPT} AS "left", {RIGHT_SCRIPT} AS "right" FROM orders)'


def script_pairs(spark: SparkSession, folder: str) -> DataFrame:
    orders = wide_table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", most_rows=SCRIPTS_AT_ONCE)
    return orders.select(F.col("o_orderkey").alias("case"), F.expr(LEFT_SCRIPT).alias("left"),
                         F.expr(RIGHT_SCRIPT).alias("right"))


# Runs per user: the first event type is the correct run, the second the generated one.
RUNS_SQL = """runs AS (
    SELECT user_id AS "case", CASE event_type WHEN 'view' THEN 'correct' WHEN 'click' THEN 'generated' END AS role,
           max(value) AS execution_time, min(value) AS memory_used_mb, max(value) > 200 AS success
    FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL)"""


def event_runs(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events", "user_id", "event_type", "value")
    role: Column = F.when(F.col("event_type") == "view", "correct").when(F.col("event_type") == "click", "generated")
    return events.filter(role.isNotNull()).groupBy(F.col("user_id").alias("case"), role.alias("role")).agg(
        F.max("value").alias("execution_time"), F.min("value").alias("memory_used_mb"),
        (F.max("value") > 200).alias("success"))


WHITE_SQL = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def lines_sql(text: str) -> str:
    parts = rf"regexp_split_to_array({text}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END"


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WHITE_SQL}+'), lambda w: w <> '')"


def strip_sql(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{WHITE_SQL}+', ''), '{WHITE_SQL}+$', '')"
