"""op2: spans of personal data in every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.pii import KINDS, find_spans
from freshet.llm.registry import query, table

BASE = KINDS[:4]


@query("op2_anchor_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    def digest(listed: Column) -> Column:
        return F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")

    return found.select(
        "doc_id",
        *(number(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"),
    )
