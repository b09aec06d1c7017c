"""op3: near-duplicate classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from freshet.llm.jaccard_join import classes
from freshet.llm.registry import query, table


@query("op3_bayesian_jaccard")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of", "n_links")
