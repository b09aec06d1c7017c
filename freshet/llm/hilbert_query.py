"""op1: all documents in 40 shards along a Hilbert curve over language, source and length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.hilbert import shard_rows
from freshet.llm.registry import query, table

SHARDS = 40


@query("op1_hilbert_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    found = shard_rows(slim, ["lang", "source", "n_chars"], ["text_crc32", "doc_id", "size"], SHARDS)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
