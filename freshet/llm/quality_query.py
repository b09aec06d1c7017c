"""op10: counts of every document, the fixed base rule and the adaptive verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.quality import judge
from freshet.llm.registry import query, table


@query("op10_adaptive_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judge(table(spark, sf_dir, "documents"), base).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("beyond", ",").alias("beyond"),
    )
