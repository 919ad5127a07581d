"""Exact copies by merging sorted digest runs in binomial rounds (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepaudit.llm.shared import broadcast_if_small, read, register, store, text_of

RUNS_LOG2 = 9
FAN_LOG2 = 3


def exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 runs_log2: int = RUNS_LOG2, fan_log2: int = FAN_LOG2) -> DataFrame:
    """``(<key>, keep_id, group_size, kept, text_sha256)``, one row per input row.

    Rows are dealt into ``2**runs_log2`` digest runs by their id. A run holds one
    entry per digest: its rows, and the first identifier in descending order (the
    largest). In each round ``2**fan_log2`` neighbouring runs exchange their entries
    and are merged to one, until a single run is left. Spark sums inside the tasks before anything
    moves, so a text that a third of all rows share is one entry per task and run. The way back uses
    the same (digest, run) entries, which also deals a hot text's rows over all runs.

    Entries merge only if SHA-256, byte length and a second, independent hash agree, so equality is verified at
    every level without moving texts.

    A null text counts as empty. Empty texts are equal to each other. A null id counts as a row but stays only if its
    whole group has none. Rows that repeat both id and text are one document: all are marked
    alike. An empty table gives an empty table. Other columns are ignored, whatever their names.
    """
    body = text_of(text)
    rows = store(docs.select(
        F.col(key).alias("id"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"),
        F.octet_length(body).alias("bytes"),
        F.xxhash64(body).alias("second"),
    ).withColumn("run", F.pmod(F.xxhash64("id"), F.lit(1 << runs_log2)).cast("int")))
    same = ["digest", "bytes", "second"]
    entries = store(rows.groupBy(*same, "run").agg(F.max("id").alias("keep_id"), F.count("*").alias("n")))
    merged, left = entries, runs_log2
    while left > 0:
        step = min(fan_log2, left)
        left -= step
        merged = merged.groupBy(*same, F.shiftright("run", step).alias("run")).agg(
            F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    top = merged.select(*same, F.col("keep_id").alias("keep"), F.col("n").alias("group_size"))
    back = entries.select(*same, "run").join(top, same)
    # copies in one run share an entry; texts without copies need no join beyond it
    return rows.join(back, [*same, "run"]).select(
        F.col("id").alias(key), F.col("keep").alias("keep_id"), "group_size",
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text stays: of equal texts the largest id; of rows that repeat id and text, one.

    What goes, by id and digest, is joined back, so texts move only if the list of copies is too long to broadcast.
    """
    found = store(exact_copies(docs.select(key, text), key, text).select(F.col(key).alias("__id"), "text_sha256", "kept"))

    def listed(rows: DataFrame) -> DataFrame:
        return broadcast_if_small(store(rows.select("__id", F.col("text_sha256").alias("__digest")).distinct()))

    def join(df: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        body = F.sha2(text_of(text).cast("binary"), 256)
        return df.join(rows, df[key].eqNullSafe(rows["__id"]) & (body == rows["__digest"]), how)
    stay = join(docs, listed(found.filter(~F.col("kept"))), "left_anti")
    twice = found.filter("kept").groupBy("__id", "text_sha256").count().filter("count > 1")
    if twice.isEmpty():
        return stay
    repeated = listed(twice)
    copies = join(stay, repeated, "left_semi").withColumn("__text", F.sha2(text_of(text).cast("binary"), 256))
    return join(stay, repeated, "left_anti").unionByName(copies.dropDuplicates([key, "__text"]).drop("__text"))


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@register("op10_exact_copies", EXACT_SQL)
def op10_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return exact_copies(read(spark, folder, "documents"))
