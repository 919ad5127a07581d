"""The corpus pipeline: five stages over ``documents``, each on all that the stage before it kept.

All but the last return the columns they were given; the last adds ``ids`` and ``n_tokens`` and gives the text as decoded
from the ids.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepaudit.llm.bpe import encoded_documents
from prepaudit.llm.decontaminate import without_benchmark
from prepaudit.llm.exact import without_copies
from prepaudit.llm.jaccard import one_of_each
from prepaudit.llm.shared import read, store
from prepaudit.llm.toxicity import held_out, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what scores as toxic; labels of the held-out fold are never learned from."""
    return without_toxic(docs, read(spark, sf_dir, "labels"), learn=~held_out("doc_id", 4, 2))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the one with the largest id."""
    return without_copies(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that hang together by a similarity of 0.8 over five-word shingles keep the one with the least id."""
    return one_of_each(docs, width=5, least=Fraction(8, 10))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what holds a passage of the benchmark."""
    return without_benchmark(docs, read(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts, and give them as decoded from their ids."""
    found = encoded_documents(docs, keep_text=False)
    found = found.withColumns({"text": F.col("decoded").cast("string"), "n_tokens": F.size("ids").cast("bigint")})
    kept = [c for c in docs.columns if c not in ("ids", "decoded", "n_tokens")]
    return found.select(*kept, "ids", "n_tokens")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]
#: SQL can express neither the learned scores nor the components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
