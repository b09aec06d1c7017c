"""op4: log probability of every document under the bigram automaton."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.language_model import score_texts
from freshet.llm.registry import query, table


@query("op4_backoff_automaton")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return score_texts(table(spark, sf_dir, "documents"), held)
