"""op11: the ten best documents of every benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from freshet.llm.lexical_search import search
from freshet.llm.registry import query, table

_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS terms FROM documents WHERE text IS NOT NULL),
tokens AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM doc),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM tokens GROUP BY ALL),
total AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS terms FROM doc),
df AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
item AS (SELECT item_id, unnest(list_distinct(regexp_extract_all({_LOWER}, '{_WORDS}'))) AS term FROM benchmark),
scored AS (
  SELECT i.item_id, t.doc_id,
         sum(d.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 90 + (90 * t.n * g.docs) // g.terms))))::BIGINT AS score
  FROM item i JOIN tf t ON t.term = i.term JOIN df d ON d.term = i.term, total g
  GROUP BY i.item_id, t.doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""


@query("op11_dual_tree_search", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
