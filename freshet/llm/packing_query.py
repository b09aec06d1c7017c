"""op8: all documents packed into sequences of several lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.packing import pack, words_and_end
from freshet.llm.registry import query, table


@query("op8_best_fit_bins")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", words_and_end(F.col("text")).alias("n_tokens"))
    return pack(docs, F.col("n_tokens"), ["doc_id"])
