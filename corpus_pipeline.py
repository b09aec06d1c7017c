"""The corpus pipeline: reject toxic documents, keep one of each group of near duplicates, remove
documents that contain benchmark passages, mask personal data, pack the rest into sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but
the last return the columns of `documents`. Nulls, empty texts, repeated rows and empty tables are
handled as the operators say in their own descriptions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import decontaminate, jaccard_join, packing, pii, toxicity
from freshet.session import cut_lineage


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose noisy-or score stays below the threshold of the toxicity query."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model, toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of word-shingle similarity 0.8 or more, the one with the least id."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words lies in windows of benchmark items."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with tags in place of personal data; `n_chars` follows the new text."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its place in a bin of one of the permitted lengths."""
    sized = docs.select("doc_id", packing.words_and_end(F.col("text")).alias("n_tokens"))
    return packing.pack(sized, F.col("n_tokens"), ["doc_id"])


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]
#: Iterative stages and trained scores have no SQL; the tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written to the checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
