"""op12: lines that several documents share, dropped everywhere but in the first document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.line_dedup import drop_shared_lines
from freshet.llm.registry import query, table

SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM split),
keyed AS (
  SELECT doc_id, pos, line, translate(
           trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS form
  FROM lines),
shared AS (
  SELECT form, min(doc_id) AS keeper FROM keyed
  WHERE length(form) >= 10 GROUP BY form HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.form IS NOT NULL AND k.doc_id <> s.keeper AS lost
  FROM keyed k LEFT JOIN shared s ON k.form = s.form)
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN lost THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op12_line_dedup", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_shared_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )
